"""Table schemas as DDL. Missing values are NULL, never NaN; money is DOUBLE."""

from __future__ import annotations

OBSERVATIONS = "entity_id STRING, series_id STRING, obs_date DATE, value DOUBLE"
PRICES = "asset_id STRING, price_date DATE, close DOUBLE, volume BIGINT"
TRADES = (
    "trade_id STRING, account_id STRING, date DATE, run_type STRING, symbol STRING, side STRING, qty DOUBLE, fill_price DOUBLE, order_type STRING, "
    "slippage_pct DOUBLE, status STRING, layer STRING, thesis STRING, mechanism_type STRING, reason STRING, retry_count INT, realized_pl DOUBLE, "
    "closed_date DATE, close_reason STRING"
)
POSITION = (
    "symbol: STRING, qty: DOUBLE, side: STRING, market_value: DOUBLE, current_price: DOUBLE, avg_entry_price: DOUBLE, unrealized_pl: DOUBLE, "
    "unrealized_plpc: DOUBLE, change_today: DOUBLE"
)
SNAPSHOT = (
    "timestamp STRING, account STRUCT<account_id: STRING, portfolio_value: DOUBLE, cash: DOUBLE, buying_power: DOUBLE>, "
    f"positions ARRAY<STRUCT<{POSITION}>>, allocations_pct MAP<STRING, DOUBLE>"
)
RUN_LOG = "ts STRING, severity STRING, phase STRING, message STRING, status STRING, details MAP<STRING, STRING>"
