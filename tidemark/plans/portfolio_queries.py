"""Registered queries: portfolio measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import align, portfolio as pf
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.registry import query

cte(
    "snaps",
    """SELECT account_id, event_id, ts, CAST(ts AS DATE) AS day, round(100000 + sum(signed) OVER (PARTITION BY account_id
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS portfolio_value FROM (SELECT CAST(user_id AS VARCHAR) AS account_id,
    event_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN value WHEN event_type = 'error' THEN -value ELSE 0 END
    AS signed FROM events)""",
)
cte(
    "snap_returns",
    """SELECT *, (portfolio_value - lag(portfolio_value) OVER a) / lag(portfolio_value) OVER a * 100 AS return_pct,
    (portfolio_value - first_value(portfolio_value) OVER a) / first_value(portfolio_value) OVER a * 100 AS total_return_pct,
    max(portfolio_value) OVER r AS high, (max(portfolio_value) OVER r - portfolio_value) / max(portfolio_value) OVER r * 100
    AS drawdown_pct FROM snaps WINDOW a AS (PARTITION BY account_id ORDER BY ts, event_id), r AS (PARTITION BY account_id
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "snaps",
)


def _returns(spark, sf):
    return pf.snapshot_returns(b.snapshots(spark, sf), "account_id", b.event_order(), "portfolio_value")


@query(
    "snapshot_returns",
    "WIN-17 WIN-18 WIN-19",
    compose(
        "SELECT account_id, event_id, portfolio_value, return_pct, total_return_pct, high, drawdown_pct FROM snap_returns",
        "snap_returns",
    ),
    "portfolio_value return_pct total_return_pct high drawdown_pct",
)
def snapshot_returns(spark, sf):
    return _returns(spark, sf).drop("ts", "day")


@query(
    "risk_report",
    "WIN-18 AGG-31",
    compose(
        """SELECT *, max_drawdown_pct >= 10 AS breach, current_drawdown_pct >= 7 AS alert FROM (SELECT account_id, count(*) AS n,
        arg_min(portfolio_value, (ts, event_id)) AS start_value, arg_max(portfolio_value, (ts, event_id)) AS end_value,
        arg_max(total_return_pct, (ts, event_id)) AS total_return_pct, max(high) AS high, max(drawdown_pct) AS max_drawdown_pct,
        arg_max(drawdown_pct, (ts, event_id)) AS current_drawdown_pct, CASE WHEN count(return_pct) >= 5 AND
        stddev_samp(return_pct) > 0 THEN (avg(return_pct / 100) - 0.045 / 252) / stddev_samp(return_pct / 100) * sqrt(252)
        ELSE 0 END AS sharpe FROM snap_returns GROUP BY 1)""",
        "snap_returns",
    ),
    "start_value end_value total_return_pct high max_drawdown_pct current_drawdown_pct sharpe",
)
def risk_report(spark, sf):
    return pf.risk_report(_returns(spark, sf), "account_id", F.struct("ts", "event_id"), "portfolio_value")


@query(
    "weekly_value_at_risk",
    "AGG-32",
    compose(
        """SELECT account_id, quantile_cont(r, 0.05) AS return_quantile, quantile_cont(r, 0.05) / 100 * arg_max(v, week) AS var
        FROM (SELECT *, (v / lag(v) OVER (PARTITION BY account_id ORDER BY week) - 1) * 100 AS r FROM (SELECT account_id,
        isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, arg_max(portfolio_value, (ts, event_id)) AS v
        FROM snaps GROUP BY 1, 2)) GROUP BY 1""",
        "snaps",
    ),
    "return_quantile var",
)
def weekly_value_at_risk(spark, sf):
    weekly = b.snapshots(spark, sf).groupBy("account_id", dates.iso_week(F.col("day")).alias("week")).agg(
        F.max_by("portfolio_value", F.struct("ts", "event_id")).alias("v")
    )
    rets = weekly.select("*", (align.pct_change(F.col("v"), 1, ["account_id"], "week") * 100).alias("r"))
    return pf.value_at_risk(rets, "account_id", "r", "v", "week")


cte("bench", "SELECT price_date, close FROM prices WHERE asset_id = 'Brand#1'", "prices")


@query(
    "benchmark_alpha",
    "WIN-19 JN-2",
    compose(
        """SELECT account_id, CAST(day AS VARCHAR) AS day, v AS portfolio_value, ret, bench, ret - bench AS alpha, 0.6 * bench +
        0.4 * bench2 AS balanced FROM (SELECT account_id, day, v, (v / first_value(v) OVER q - 1) * 100 AS ret, (c /
        first_value(c) OVER q - 1) * 100 AS bench, (c2 / first_value(c2) OVER q - 1) * 100 AS bench2 FROM (SELECT d.*, a.close
        AS c, z.close AS c2 FROM (SELECT account_id, day, arg_max(portfolio_value, (ts, event_id)) AS v,
        day - 9000 AS bday FROM snaps GROUP BY account_id, day) d ASOF LEFT JOIN (SELECT * FROM prices WHERE asset_id =
        'Brand#1') a ON d.bday >= a.price_date ASOF LEFT JOIN (SELECT * FROM prices WHERE asset_id = 'Brand#2') z
        ON d.bday >= z.price_date) WINDOW q AS (PARTITION BY account_id ORDER BY day))""",
        "snaps",
        "prices",
    ),
    "portfolio_value ret bench alpha balanced",
)
def benchmark_alpha(spark, sf):
    from pyspark.sql import Window

    daily = b.snapshots(spark, sf).groupBy("account_id", "day").agg(
        F.max_by("portfolio_value", F.struct("ts", "event_id")).alias("v")
    )
    # The benchmark is looked up once per date, then joined by date.
    days = daily.select("day").distinct().select("day", F.date_sub("day", 9000).alias("bday"), F.lit(0).alias("one"))
    prices = b.prices(spark, sf)
    for name, brand in (("c", "Brand#1"), ("c2", "Brand#2")):
        one = prices.where(F.col("asset_id") == brand).select(F.lit(0).alias("one"), "price_date", F.col("close").alias(name))
        days = align.asof_backward(days, one, ["one"], "bday", "price_date", [name]).drop("matched_time")
    q = Window.partitionBy("account_id").orderBy("day")
    cum = lambda c: (F.col(c) / F.first(c).over(q) - 1) * 100
    joined = daily.join(days, "day").select("account_id", "day", "v", cum("v").alias("ret"), cum("c").alias("bench"), cum("c2").alias("bench2"))
    return joined.select(
        "account_id", "day", F.col("v").alias("portfolio_value"), "ret", "bench",
        (F.col("ret") - F.col("bench")).alias("alpha"),
        (F.col("bench") * 0.6 + F.col("bench2") * 0.4).alias("balanced"),
    )


cte(
    "trades",
    """SELECT CAST(l_suppkey AS VARCHAR) AS account_id, CAST(l_partkey AS VARCHAR) AS symbol, CASE l_returnflag WHEN 'A' THEN
    'regime' WHEN 'N' THEN 'thesis_tactical' END AS layer, l_linestatus AS mechanism, CASE WHEN l_returnflag = 'N' THEN 'thesis '
    || l_linenumber ELSE '' END AS thesis, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'F' THEN
    round(l_extendedprice * (l_discount - l_tax), 4) END AS realized_pl, * FROM lineitem""",
)
_LINE = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "rolling_win_rate",
    "WIN-20",
    compose(
        f"""SELECT account_id, CAST(date AS VARCHAR) AS date, l_orderkey, l_linenumber, l_partkey, avg(CASE WHEN
        realized_pl > 0 THEN 100.0::DOUBLE ELSE 0 END) OVER (PARTITION BY account_id ORDER BY {_LINE} ROWS 19 PRECEDING)
        AS win_rate FROM trades WHERE realized_pl IS NOT NULL""",
        "trades",
    ),
    "win_rate",
)
def rolling_win_rate(spark, sf):
    closed = b.trades(spark, sf).where(F.col("realized_pl").isNotNull())
    out = pf.rolling_win_rate(closed, "account_id", [F.col(c) for c in b.LINE_ORDER], F.trunc("date", "month"), "realized_pl")
    return out.select("account_id", "date", "l_orderkey", "l_linenumber", "l_partkey", "win_rate")


@query(
    "win_rates",
    "AGG-25",
    compose(
        """SELECT scope, name, closed, wins, losses, win_rate, avg_win, avg_loss, CASE WHEN avg_loss <> 0 THEN
        abs(avg_win / avg_loss) END AS profit_factor FROM (SELECT CASE WHEN grouping(layer) = 0 THEN 'layer' WHEN
        grouping(mechanism) = 0 THEN 'mechanism' ELSE 'all' END AS scope, coalesce(layer, mechanism, 'all') AS name, count(*)
        AS closed, count(*) FILTER (realized_pl > 0) AS wins, count(*) FILTER (realized_pl <= 0) AS losses,
        count(*) FILTER (realized_pl > 0) * 100.0::DOUBLE / count(*) AS win_rate, coalesce(avg(realized_pl) FILTER
        (realized_pl > 0), 0) AS avg_win, coalesce(avg(realized_pl) FILTER (realized_pl <= 0), 0) AS avg_loss FROM trades
        WHERE realized_pl IS NOT NULL GROUP BY GROUPING SETS ((), (layer), (mechanism)))""",
        "trades",
    ),
    "win_rate avg_win avg_loss profit_factor",
)
def win_rates(spark, sf):
    return pf.win_rates(b.trades(spark, sf))


@query(
    "trade_attribution",
    "AGG-26",
    compose(
        """SELECT scope, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'layer' AS scope, coalesce(layer, 'regime') AS name, 1 AS n FROM trades
        UNION ALL SELECT 'mechanism', coalesce(mechanism, 'unknown'), 1 FROM trades UNION ALL SELECT 'thesis', thesis, 1
        FROM trades WHERE thesis <> '' UNION ALL SELECT 'layer', x, 0 FROM (VALUES ('regime'), ('thesis_tactical'),
        ('thesis_structural')) k(x)) GROUP BY 1, 2""",
        "trades",
    ),
)
def trade_attribution(spark, sf):
    return pf.attribution(b.trades(spark, sf))


def _holdings_cte(name: str, where: str) -> None:
    cte(
        name,
        f"""SELECT CAST(o_custkey AS VARCHAR) AS account_id, CAST(p.p_partkey AS VARCHAR) AS symbol, qty, p_retailprice AS price,
        entry_price, n_name AS currency, r_name AS geography, CASE WHEN p_size <= 30 THEN p_type END AS sector, CASE WHEN
        p_size <= 30 THEN 'equities' WHEN p_size <= 40 THEN 'bonds' ELSE 'fund' END AS asset_class, CASE WHEN p_size % 3 = 0 THEN
        'regime' WHEN p_size % 3 = 1 THEN 'thesis_tactical' ELSE 'thesis_structural' END AS layer, CASE WHEN p_size % 3 = 0 THEN ''
        ELSE p_brand END AS thesis, p_size AS size, c_acctbal AS cash FROM (SELECT o_custkey, l_partkey, sum(l_quantity) AS qty,
        avg(l_extendedprice / l_quantity) AS entry_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey {where}
        GROUP BY 1, 2) JOIN part p ON l_partkey = p.p_partkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    )


_holdings_cte("holdings", "")
cte(
    "fx",
    """SELECT n_name AS src, 'BASE' AS dst, 1 + n_nationkey / 10 AS rate FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'BASE',
    n_name, 2 + n_nationkey / 10 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, 'USD', 0.5 + n_nationkey / 10
    FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'USD', 'BASE', 1.25 FROM nation WHERE n_nationkey = 0""",
)
cte(
    "rates",
    """SELECT currency, arg_min(rate, rk) AS rate FROM (SELECT src AS currency, rate, 1 AS rk FROM fx WHERE dst = 'BASE' UNION ALL
    SELECT dst, 1 / rate, 2 FROM fx WHERE src = 'BASE' UNION ALL SELECT src, rate * 1.25, 3 FROM fx WHERE dst = 'USD'
    UNION ALL SELECT 'BASE', 1.0, 0) GROUP BY 1""",
    "fx",
)


def _valued_cte(name: str, source: str) -> None:
    cte(
        name,
        f"""SELECT *, CASE WHEN sum(value_base) OVER (PARTITION BY account_id) > 0 THEN value_base / sum(value_base) OVER
        (PARTITION BY account_id) * 100 ELSE 0 END AS allocation_pct FROM (SELECT h.*, coalesce(r.rate, 1.0) AS rate,
        r.rate IS NULL AS rate_missing, price * qty AS value_native, price * qty * coalesce(r.rate, 1.0) AS value_base,
        CASE WHEN entry_price > 0 THEN (price - entry_price) * qty END AS pl_abs, CASE WHEN entry_price > 0 THEN
        (price - entry_price) / entry_price * 100 END AS pl_pct FROM {source} h LEFT JOIN rates r ON h.currency = r.currency)""",
        source,
        "rates",
    )


_valued_cte("valued", "holdings")


#: What exposures read of a holding.
_SPREAD = ("currency", "geography", "asset_class", "asset_classes", "sector", "sector_weightings")


def _valued(spark, sf, priorities=None, cols=()):
    return pf.holding_values(b.holdings(spark, sf, priorities), pf.resolve_rates(b.fx(spark, sf), "BASE"), cols)


@query("fx_rates", "JN-8", compose("SELECT currency, rate::DOUBLE AS rate FROM rates", "rates"), "rate")
def fx_rates(spark, sf):
    return pf.resolve_rates(b.fx(spark, sf), "BASE")


@query(
    "holding_values",
    "SC-21 JN-8",
    compose(
        """SELECT account_id, symbol, currency, rate::DOUBLE AS rate, rate_missing, value_native, value_base, pl_abs, pl_pct,
        allocation_pct FROM valued""",
        "valued",
    ),
    "rate value_native value_base pl_abs pl_pct allocation_pct",
)
def holding_values(spark, sf):
    return _valued(spark, sf).select(
        "account_id", "symbol", "currency", "rate", "rate_missing", "value_native", "value_base", "pl_abs", "pl_pct", "allocation_pct"
    )


def _exposure_sql(source: str, extra: str = "") -> str:
    parts = [
        ("currency", "currency", "1", "true"),
        ("geography", "geography", "1", "true"),
        ("asset_class", "asset_class", "1", "size <= 40"),
        ("asset_class", "'equities'", "size / 100", "size > 40"),
        ("asset_class", "'fixed_income'", "(1 - size / 100)", "size > 40 AND size < 100"),
        ("sector", "sector", "1", "size <= 30"),
        ("sector", "'N/A (' || asset_class || ')'", "1", "size > 30 AND size <= 40"),
        ("sector", "'Technology'", "0.6", "size > 40"),
        ("sector", "'Energy'", "size / 200", "size > 40"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT account_id, '{d}' AS dim, {lab} AS label, allocation_pct * {w} AS p, thesis FROM {source} WHERE {c}" for d, lab, w, c in parts
    )
    return f"SELECT account_id, dim, label, sum(p) AS pct{extra} FROM ({rows}) GROUP BY 1, 2, 3"


@query("exposure", "AGG-29", compose(_exposure_sql("valued"), "valued"), "pct")
def exposure(spark, sf):
    return pf.exposure(_valued(spark, sf, cols=_SPREAD))


_PAPER, _EXTERNAL = ("1-URGENT", "2-HIGH"), ("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_holdings_cte("paper_holdings", f"WHERE o_orderpriority IN {_PAPER}")
_holdings_cte("external_holdings", f"WHERE o_orderpriority IN {_EXTERNAL}")
_valued_cte("paper_valued", "paper_holdings")
_valued_cte("external_valued", "external_holdings")
cte("paper_exposure", _exposure_sql("paper_valued", ", sum(CASE WHEN thesis <> '' THEN p ELSE 0 END) AS thesis_pct"), "paper_valued")
cte("external_exposure", _exposure_sql("external_valued"), "external_valued")


@query(
    "exposure_gap",
    "AGG-30",
    compose(
        """SELECT account_id, dim, label, paper_pct, external_pct, delta, rank, rank <= 5 AS top, CASE WHEN label = 'outside investable'
        THEN 'structural' WHEN paper_pct = 0 THEN 'external-only' WHEN thesis_pct > 0 THEN 'thesis-driven' ELSE 'regime-driven' END
        AS driver FROM (SELECT *, paper_pct - external_pct AS delta, row_number() OVER (PARTITION BY account_id, dim ORDER BY
        abs(round(paper_pct - external_pct, 6)) DESC, label) AS rank FROM (SELECT account_id, dim, CASE WHEN dim = 'asset_class' AND
        label NOT IN ('equities', 'fund') THEN 'outside investable' ELSE label END AS label, sum(coalesce(a.pct, 0)) AS paper_pct,
        sum(coalesce(z.pct, 0)) AS external_pct, sum(coalesce(thesis_pct, 0)) AS thesis_pct FROM paper_exposure a FULL JOIN
        external_exposure z USING (account_id, dim, label) GROUP BY 1, 2, 3)) WHERE abs(delta) > 5""",
        "paper_exposure",
        "external_exposure",
    ),
    "paper_pct external_pct delta",
)
def exposure_gap(spark, sf):
    paper_lots = _valued(spark, sf, _PAPER, (*_SPREAD, "thesis"))
    total = pf.exposure(paper_lots)
    thesis = pf.exposure(paper_lots.where(F.col("thesis") != "")).withColumnRenamed("pct", "thesis_pct")
    paper = total.join(thesis, ["account_id", "dim", "label"], "left").na.fill(0.0, ["thesis_pct"])
    return pf.exposure_gap(paper, pf.exposure(_valued(spark, sf, _EXTERNAL, _SPREAD)), ["equities", "fund"])


cte(
    "positions",
    """SELECT *, market_value / portfolio_value * 100 AS allocation_pct FROM (SELECT *, sum(market_value) OVER (PARTITION BY
    account_id) + cash AS portfolio_value FROM (SELECT account_id, symbol, qty, price AS current_price, entry_price AS
    avg_entry_price, price * qty AS market_value, (price - entry_price) * qty AS unrealized_pl, (price - entry_price) /
    entry_price AS unrealized_plpc, price * qty * (size - 25) / 1000 AS change_today, layer, thesis, sector, cash, size
    FROM holdings))""",
    "holdings",
)


@query(
    "position_allocations",
    "SC-23 SRC-16",
    compose(
        """SELECT account_id, symbol, allocation_pct AS pct FROM positions UNION ALL SELECT DISTINCT account_id, 'CASH',
        cash / portfolio_value * 100 FROM positions""",
        "positions",
    ),
    "pct",
)
def position_allocations(spark, sf):
    held = b.positions(spark, sf, "account_id", "symbol", "cash", "portfolio_value", "allocation_pct")
    cash = held.groupBy("account_id").agg(F.max(F.col("cash") / F.col("portfolio_value") * 100).alias("pct"))
    return held.select("account_id", "symbol", F.col("allocation_pct").alias("pct")).unionByName(
        cash.select("account_id", F.lit("CASH").alias("symbol"), "pct")
    )


@query(
    "account_rollup",
    "AGG-28",
    compose(
        """SELECT account_id, count(*) AS n_positions, max(cash / portfolio_value * 100) AS cash_pct, sum(CASE WHEN thesis <> '' THEN
        allocation_pct ELSE 0 END) AS overlay_pct, arg_max(symbol, (round(allocation_pct, 6), symbol)) AS largest,
        max(allocation_pct) AS largest_pct, sum(unrealized_pl) AS unrealized_pl, sum(change_today) AS change_today, sum(CASE WHEN
        abs(unrealized_plpc) < 10 THEN unrealized_plpc * 100 ELSE unrealized_plpc END * allocation_pct) / sum(allocation_pct)
        AS return_pct FROM positions GROUP BY 1""",
        "positions",
    ),
    "cash_pct overlay_pct largest_pct unrealized_pl change_today return_pct",
)
def account_rollup(spark, sf):
    return pf.rollup_accounts(b.positions(spark, sf))


@query(
    "layer_contribution",
    "AGG-27",
    compose(
        """SELECT *, CASE WHEN allocation_pct > 0 THEN contribution / allocation_pct * 100 ELSE 0 END AS layer_return FROM (SELECT
        account_id, layer, count(*) AS n_positions, sum(allocation_pct) AS allocation_pct, sum(allocation_pct *
        (current_price - avg_entry_price) / avg_entry_price) AS contribution FROM positions GROUP BY 1, 2)""",
        "positions",
    ),
    "allocation_pct contribution layer_return",
)
def layer_contribution(spark, sf):
    return pf.layer_contribution(b.positions(spark, sf))


@query(
    "unrealised_total",
    "AGG-43",
    compose(
        """SELECT account_id, sum(unrealized_pl) AS unrealized_pl, CASE WHEN max(portfolio_value) > 0 THEN sum(unrealized_pl) /
        max(portfolio_value) * 100 ELSE 0 END AS unrealized_pct FROM positions GROUP BY 1""",
        "positions",
    ),
    "unrealized_pl unrealized_pct",
)
def unrealised_total(spark, sf):
    held = b.positions(spark, sf)
    snaps = held.groupBy("account_id").agg(F.max("portfolio_value").alias("portfolio_value"))
    return pf.unrealised_total(held, snaps, ["account_id"])


@query(
    "pnl_ranking",
    "TOP-4",
    compose(
        """SELECT account_id, symbol, unrealized_pl, rank, worst <= 3 AS worst_three FROM (SELECT *, row_number() OVER (PARTITION BY
        account_id ORDER BY round(unrealized_pl, 6) DESC, symbol) AS rank, row_number() OVER (PARTITION BY account_id ORDER BY
        round(unrealized_pl, 6), symbol) AS worst FROM positions) WHERE rank <= 5 OR worst <= 3""",
        "positions",
    ),
    "unrealized_pl",
)
def pnl_ranking(spark, sf):
    return pf.best_and_worst(b.positions(spark, sf, "account_id", "symbol", "unrealized_pl"), "account_id", "unrealized_pl", "symbol")


@query(
    "latest_known_attributes",
    "JN-6",
    compose(
        f"""SELECT account_id, symbol, coalesce(nullif(CASE WHEN size > 25 THEN p.layer ELSE '' END, ''), k.layer, '') AS layer,
        coalesce(nullif(p.thesis, ''), k.thesis, '') AS thesis FROM positions p LEFT JOIN (SELECT symbol, layer, thesis FROM trades
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC,
        l_suppkey DESC) = 1) k USING (symbol)""",
        "positions",
        "trades",
    ),
)
def latest_known_attributes(spark, sf):
    held = b.positions(spark, sf).select(
        "account_id", "symbol", F.when(F.col("size") > 25, F.col("layer")).otherwise("").alias("layer"), "thesis"
    )
    known = pf.latest_attributes(b.trades(spark, sf), "symbol", F.struct(*b.LINE_ORDER), ["layer", "thesis"])
    return pf.fill_attributes(held, known, "symbol", ["layer", "thesis"]).select("account_id", "symbol", "layer", "thesis")


@query(
    "attach_pnl",
    "JN-7",
    compose(
        """SELECT h.account_id, h.symbol, h.qty, p.unrealized_pl FROM holdings h LEFT JOIN (SELECT * FROM positions WHERE size % 2 = 0) p
        ON h.account_id = p.account_id AND h.symbol = p.symbol""",
        "holdings",
        "positions",
    ),
    "qty unrealized_pl",
)
def attach_pnl(spark, sf):
    held = b.holdings(spark, sf).select("account_id", "symbol", "qty")
    perf = b.positions(spark, sf, "account_id", "symbol", "unrealized_pl", "size").where(F.col("size") % 2 == 0).select("account_id", "symbol", "unrealized_pl")
    return held.join(perf, ["account_id", "symbol"], "left")


@query(
    "execution_quality",
    "AGG-33",
    """SELECT o_orderpriority, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 100.0::DOUBLE ELSE 0 END) AS fill_rate, avg(CASE WHEN
    o_orderstatus = 'P' THEN 100.0::DOUBLE ELSE 0 END) AS rejection_rate, avg(CASE WHEN o_orderstatus = 'F' THEN (l_extendedprice /
    l_quantity - p_retailprice) / p_retailprice * 100 END) AS slippage_pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "fill_rate rejection_rate slippage_pct",
)
def execution_quality(spark, sf):
    status = F.col("o_orderstatus")
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("planned_price"))
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_orderpriority",
        F.when(status == "F", "filled").when(status == "P", "rejected").otherwise("pending").alias("status"),
    )
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("fill_price"))
    return pf.execution_quality(lines.join(orders, "l_orderkey").join(part, "l_partkey"), ["o_orderpriority"])


@query(
    "bear_case_accuracy",
    "AGG-34",
    compose(
        """SELECT coalesce(layer, 'regime') AS layer, count(*) AS n, count(*) FILTER (l_linenumber > 2 AND l_tax > 0.04) AS realized,
        count(*) FILTER (l_linenumber > 2 AND l_tax <= 0.04) AS not_realized, count(*) FILTER (realized_pl < 0 AND NOT
        (l_linenumber > 2 AND l_tax > 0.04)) AS unarticulated_losses FROM trades WHERE realized_pl IS NOT NULL GROUP BY 1""",
        "trades",
    ),
)
def bear_case_accuracy(spark, sf):
    closed = b.trades(spark, sf).where(F.col("realized_pl").isNotNull()).select(
        F.coalesce("layer", F.lit("regime")).alias("layer"),
        "realized_pl",
        F.when(F.col("l_linenumber") > 2, "said").otherwise("").alias("bear_case"),
        (F.col("l_tax") > 0.04).alias("bear_case_realized"),
    )
    return pf.bear_case_accuracy(closed, ["layer"])


@query(
    "fund_classes",
    "SC-22",
    """SELECT p_partkey, CASE WHEN stock > 0.5 THEN 'equities' WHEN bond > 0.5 THEN 'fixed_income' WHEN other > 0.5 THEN CASE WHEN
    contains(lower(p_name), 'currency') THEN 'fx_currency' ELSE 'other' END ELSE 'mixed' END AS asset_class, CASE WHEN p_size % 4 = 0
    THEN CASE WHEN contains(lower(p_type), 'promo') THEN 'US' ELSE 'US' END WHEN p_size % 4 = 1 THEN 'Europe' WHEN p_size % 4 = 2 THEN
    'Japan' ELSE 'XYZ' END AS geography, CASE WHEN stock >= bond THEN 'Technology' ELSE 'Energy' END AS sector FROM (SELECT *,
    p_size / 50 AS stock, CASE WHEN p_size % 2 = 0 THEN 1 - p_size / 50 ELSE 0 END AS bond, CASE WHEN p_size % 2 = 1 THEN
    1 - p_size / 50 ELSE 0 END AS other FROM part)""",
)
def fund_classes(spark, sf):
    size = F.col("p_size")
    rest = 1 - size / 50
    even = size % 2 == 0
    weights = F.create_map(
        F.lit("stockPosition"), size / 50, F.lit("bondPosition"), F.when(even, rest).otherwise(0.0), F.lit("otherPosition"), F.when(even, 0.0).otherwise(rest)
    )
    # Equal weights resolve to the first key in alphabetical order, so the stock-like key is named second here.
    sectors = F.create_map(F.lit("technology"), size / 50 + 1e-9, F.lit("energy"), F.when(even, rest).otherwise(0.0))
    exchange = F.when(size % 4 == 0, "NYQ").when(size % 4 == 1, "LSE").when(size % 4 == 2, "TYO").otherwise("XYZ")
    return b.table(spark, sf, "part").select(
        "p_partkey",
        pf.fund_class(weights, F.col("p_name")).alias("asset_class"),
        pf.fund_geography(exchange, F.col("p_type")).alias("geography"),
        pf.primary_sector(sectors).alias("sector"),
    )


@query(
    "limit_resets",
    "SC-24",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0 AND abs(lim - ask) / ask * 100 > 5 THEN ask * 1.003
    ELSE lim END AS limit_price FROM (SELECT *, l_extendedprice / l_quantity AS lim, p_retailprice AS ask FROM lineitem JOIN part ON
    l_partkey = p_partkey)""",
    "limit_price",
)
def limit_resets(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = b.table(spark, sf, "lineitem").join(part, "l_partkey")
    ask = F.when(F.col("l_tax") > 0, F.col("p_retailprice"))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", pf.limit_reset(F.col("l_extendedprice") / F.col("l_quantity"), ask).alias("limit_price")
    )


#: Lines beyond which trades are written in halves.
HALVED_LINES = 1 << 23

cte(
    "lots",
    """SELECT entity_id, p_brand AS symbol, day AS date, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS qty,
    l_extendedprice / l_quantity AS price, row_number() OVER (PARTITION BY entity_id, p_brand, l_returnflag = 'R' ORDER BY day,
    l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k, sum(l_quantity) OVER (PARTITION BY entity_id, p_brand,
    l_returnflag = 'R' ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS hi
    FROM elines JOIN part ON l_partkey = p_partkey""",
    "elines",
)


@query(
    "fifo_matches",
    "JN-13",
    compose(
        """SELECT entity_id, symbol, CAST(b.date AS VARCHAR) AS entry_date, CAST(s.date AS VARCHAR) AS exit_date, b.price AS entry_price,
        s.price AS exit_price, least(b.hi, s.hi) - greatest(b.hi - b.qty, s.hi - s.qty) AS qty, (s.price - b.price) * (least(b.hi, s.hi)
        - greatest(b.hi - b.qty, s.hi - s.qty)) AS realized_pl, (s.price - b.price) / b.price * 100 AS realized_pl_pct,
        CAST(s.date - b.date AS BIGINT) AS holding_days FROM (SELECT * FROM lots WHERE side = 'buy') b JOIN (SELECT * FROM lots WHERE
        side = 'sell') s USING (entity_id, symbol) WHERE b.hi > s.hi - s.qty AND s.hi > b.hi - b.qty""",
        "lots",
    ),
    "entry_price exit_price qty realized_pl realized_pl_pct",
)
def fifo_matches(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    lots = b.entity_lines(spark, sf).join(part, "l_partkey").select(
        "entity_id",
        "symbol",
        F.col("day").alias("date"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.unix_date("day").alias("_day"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    # Two joins shuffle whole lines: many lines are joined and written in halves by order.
    many = b.table(spark, sf, "lineitem").count() > HALVED_LINES
    halves = [F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == i for i in range(2)] if many else []
    return pf.match_fifo(lots, ["entity_id", "symbol"], b.LINE_ORDER, slices=halves)


@query(
    "duplicate_orders",
    "JN-14",
    """SELECT account_id, event_id, coalesce(date_diff('microsecond', prev, ts) <= 86400000000, false) AS duplicate FROM (SELECT
    CAST(user_id AS VARCHAR) AS account_id, event_id, ts, max(CASE WHEN event_id % 3 > 0 THEN ts END) OVER (PARTITION BY user_id, event_type,
    floor(value / 10) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)""",
)
def duplicate_orders(spark, sf):
    ev = b.events(spark, sf).select("account_id", "event_id", "event_type", F.floor(F.col("value") / 10).alias("qty"), "ts")
    out = pf.duplicate_orders(ev, ["account_id", "event_type", "qty"], "ts", "event_id", pending=F.col("event_id") % 3 > 0)
    return out.select("account_id", "event_id", "duplicate")


@query(
    "retry_counts",
    "WIN-23",
    """SELECT account_id, event_id, event_type, (SELECT NULL) IS NULL AND event_type = 'purchase' AS filled, CAST(cum - open -
    coalesce(max(base) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    AS retry_count FROM (SELECT *, CASE WHEN open = 0 THEN cum END AS base FROM (SELECT *, sum(open) OVER (PARTITION BY account_id
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, event_id, ts, event_type,
    CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS open FROM events)))""",
)
def retry_counts(spark, sf):
    filled = F.col("event_type") == "purchase"
    at, tie = b.event_order()
    out = pf.retry_count(b.events(spark, sf), ["account_id"], at, "event_id", filled)
    return out.select("account_id", "event_id", "event_type", filled.alias("filled"), "retry_count")
