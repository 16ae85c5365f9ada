"""Registered queries: foreign formats. Each writes data derived from the given tables in the format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import align, signals as sg
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose
from tidemark.plans.panel_queries import regimes
from tidemark.plans.registry import query
from tidemark.session import materialise, scratch_path
from tidemark.sources import readers as rd, sinks as sk


def _monthly(spark, sf):
    return align.resample_last(b.observations(spark, sf))


def _landed(df, label: str) -> str:
    """Write a one-column text table to the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.text(path)
    return path


def _documents(monthly, keys, doc):
    """One JSON document per key from its calendar-grain rows."""
    point = F.struct("month", "series_id", "value")
    return monthly.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("ps")).select(F.to_json(doc).alias("value"))


@query(
    "landed_observations",
    "SRC-1",
    compose("SELECT entity_id, series_id, CAST(obs_date AS VARCHAR) AS obs_date, value FROM obs", "obs"),
    "value",
)
def landed_observations(spark, sf):
    path = scratch_path(spark, "observations")
    b.observations(spark, sf).write.option("header", True).csv(path)
    return rd.read_observations(spark, path, "csv", header=True)


@query(
    "landed_prices",
    "SRC-2",
    compose("SELECT asset_id, CAST(price_date AS VARCHAR) AS price_date, close, volume FROM prices WHERE day(price_date) <> 13", "prices"),
    "close",
)
def landed_prices(spark, sf):
    path = scratch_path(spark, "prices")
    # Missing closes come as null or as NaN.
    gone = F.when(F.month("price_date") % 2 == 0, F.lit(float("nan")))
    b.prices(spark, sf).withColumn("close", F.when(F.dayofmonth("price_date") == 13, gone).otherwise(F.col("close"))).write.parquet(path)
    return rd.read_prices(spark, path)


@query(
    "sdmx_json",
    "SRC-3",
    compose("SELECT entity_id || '/' || series_id AS area, CAST(month AS VARCHAR) AS period, value FROM monthly", "monthly"),
    "value",
)
def sdmx_json(spark, sf):
    monthly = _monthly(spark, sf)
    periods = F.transform("ps", lambda p: F.struct(p["month"].cast("string").alias("id")))
    observations = F.map_from_entries(F.transform("ps", lambda p, i: F.struct(i.cast("string"), F.array(p["value"]))))
    dim = lambda name, vals: F.struct(F.lit(name).alias("id"), vals.alias("values"))
    doc = F.struct(
        F.struct(
            F.struct(
                F.struct(
                    F.array(dim("REF_AREA", F.array(F.struct(F.concat_ws("/", "entity_id", "series_id").alias("id"))))).alias("series"),
                    F.array(dim("TIME_PERIOD", periods)).alias("observation"),
                ).alias("dimensions")
            ).alias("structure"),
            F.array(F.struct(F.create_map(F.lit("0:0:0"), F.struct(observations.alias("observations"))).alias("series"))).alias("dataSets"),
        ).alias("data")
    )
    path = _landed(_documents(monthly, ["entity_id", "series_id"], doc), "sdmx")
    return rd.read_sdmx_json(spark, path, wholetext=False)


@query(
    "json_stat",
    "SRC-4",
    compose(
        "SELECT entity_id || '/' || series_id AS label, CAST(month AS VARCHAR) AS period, value FROM monthly WHERE value > 1", "monthly"
    ),
    "value",
)
def json_stat(spark, sf):
    values = F.map_from_entries(
        F.filter(F.transform("ps", lambda p, i: F.struct(i.cast("string").alias("k"), p["value"].alias("v"))), lambda e: e["v"] > 1)
    )
    index = F.map_from_entries(F.transform("ps", lambda p, i: F.struct(p["month"].cast("string"), i)))
    doc = F.struct(
        F.concat_ws("/", "entity_id", "series_id").alias("label"),
        values.alias("value"),
        F.struct(F.struct(F.struct(index.alias("index")).alias("category")).alias("time")).alias("dimension"),
    )
    return rd.read_json_stat(spark, _landed(_documents(_monthly(spark, sf), ["entity_id", "series_id"], doc), "jsonstat"), wholetext=False)


BULK = ("M2SL.7", "NFCI.11", "INDPRO.3")


@query(
    "bulk_series",
    "SRC-5",
    compose(
        f"""SELECT series_id, CAST(month AS VARCHAR) AS obs_date, value FROM (SELECT series_id || '.' || entity_id AS series_id, month, value FROM monthly)
        WHERE series_id IN {BULK} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY month DESC) <= 52""",
        "monthly",
    ),
    "value",
)
def bulk_series(spark, sf):
    points = F.reverse(F.transform("ps", lambda p: F.array(F.date_format(p["month"], "yyyyMMdd"), p["value"].cast("string"))))
    doc = F.struct(F.concat_ws(".", "series_id", "entity_id").alias("series_id"), points.alias("data"))
    lines = _documents(_monthly(spark, sf), ["entity_id", "series_id"], doc)
    broken = b.table(spark, sf, "region").select(F.concat(F.lit('{"series_id": "M2SL.7", broken '), "r_name").alias("value"))
    return rd.read_bulk_series(spark, _landed(lines.unionByName(broken), "bulk"), BULK, last=52)


@query(
    "coded_csv",
    "SRC-6",
    """SELECT CAST(o_custkey AS VARCHAR) AS area, CAST(o_orderkey AS VARCHAR) AS period, o_totalprice AS value FROM orders WHERE o_orderpriority = '2-HIGH' AND
    o_orderstatus = 'F' AND o_orderkey % 5 <> 0""",
    "value",
)
def coded_csv(spark, sf):
    path = scratch_path(spark, "coded")
    b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("area"), F.col("o_orderkey").alias("period"), F.col("o_orderpriority").alias("UNIT"), F.col("o_orderstatus").alias("SECTOR"),
        F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("OBS_VALUE"),
    ).write.option("header", True).csv(path)
    return rd.read_coded_csv(spark, path, {"UNIT": "2-HIGH", "SECTOR": "F"}, ["area", "period"])


@query(
    "net_positioning",
    "SRC-7",
    compose(
        """SELECT contract, CAST(week AS VARCHAR) AS report_date, long_qty, short_qty, long_qty - short_qty AS net FROM net_positions""",
        "net_positions",
    ),
    "long_qty short_qty net",
)
def net_positioning(spark, sf):
    wide = b.net_positions(spark, sf).select(
        "contract",
        F.col("week").alias("report_date"),
        F.when(F.col("contract") != "Brand#2", F.col("long_qty")).alias("money_long"),
        F.when(F.col("contract") != "Brand#2", F.col("short_qty")).alias("money_short"),
        F.when(F.col("contract") == "Brand#2", F.col("long_qty")).alias("asset_long"),
        F.when(F.col("contract") == "Brand#2", F.col("short_qty")).alias("asset_short"),
    )
    money, asset = ("money_long", "money_short"), ("asset_long", "asset_short")
    return rd.net_positions(wide, {f"Brand#{i}": asset if i == 2 else money for i in range(1, 26)})


@query(
    "country_years",
    "SRC-8",
    compose(
        """SELECT series_id AS indicator, entity_id AS country, CAST(year(month) AS BIGINT) AS year, arg_max(value, month) AS value FROM monthly GROUP BY 1, 2, 3""",
        "monthly",
    ),
    "value",
)
def country_years(spark, sf):
    yearly = _monthly(spark, sf).groupBy("series_id", "entity_id", F.year("month").cast("string").alias("year")).agg(F.max_by("value", "month").alias("value"))
    per_country = yearly.groupBy("series_id", "entity_id").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("y"))
    doc = F.struct(F.create_map("series_id", F.create_map("entity_id", "y")).alias("values"))
    return rd.read_country_years(spark, _landed(per_country.select(F.to_json(doc).alias("value")), "country-years"), wholetext=False)


@query(
    "meta_records",
    "SRC-9",
    compose(
        """SELECT entity_id || '/' || series_id AS country, CAST(year(month) AS BIGINT) AS year, arg_max(value, month) AS value, entity_id = '3' AS truncated FROM
        monthly GROUP BY entity_id, series_id, 2 HAVING arg_max(value, month) > 2""",
        "monthly",
    ),
    "value",
)
def meta_records(spark, sf):
    yearly = _monthly(spark, sf).groupBy("entity_id", "series_id", F.year("month").alias("year")).agg(F.max_by("value", "month").alias("v"))
    record = F.struct(
        F.struct(F.concat_ws("/", "entity_id", "series_id").alias("id")).alias("country"), F.col("year").cast("string").alias("date"), F.when(F.col("v") > 2, F.col("v")).alias("value")
    )
    docs = yearly.groupBy("entity_id", "series_id").agg(F.collect_list(record).alias("records"))
    pages = F.when(F.col("entity_id") == "3", '{"pages": 2}').otherwise('{"pages": 1}')
    text = F.concat(F.lit("["), pages, F.lit(", "), F.to_json("records"), F.lit("]"))
    return rd.read_meta_records(spark, _landed(docs.select(text.alias("value")), "meta-records"), wholetext=False)


@query(
    "landed_snapshots",
    "SRC-10 SRC-16",
    compose(
        """SELECT account_id, symbol, qty, market_value, unrealized_pl, portfolio_value FROM positions""",
        "positions",
    ),
    "qty market_value unrealized_pl portfolio_value",
)
def landed_snapshots(spark, sf):
    path = scratch_path(spark, "snapshots")
    held = b.positions(spark, sf)
    position = F.struct("symbol", "qty", F.lit("long").alias("side"), "market_value", "current_price", "avg_entry_price", "unrealized_pl", "unrealized_plpc", "change_today")
    # One document per account; an account holds at most one row per instrument.
    docs = held.groupBy("account_id", "portfolio_value", "cash").agg(F.collect_list(position).alias("positions")).select(
        F.lit("2024-01-30T00:00:00Z").alias("timestamp"),
        F.struct("account_id", "portfolio_value", "cash", F.col("cash").alias("buying_power")).alias("account"),
        "positions",
    )
    docs.write.json(path, compression="gzip")
    accounts, plain, results = rd.account_tables(rd.read_snapshots(spark, path, "part-*.json.gz", wholetext=False))
    keys = ["account_id", "ts"]
    return plain.join(results, [*keys, "symbol"]).join(accounts, keys).select(
        "account_id", "symbol", "qty", "market_value", "unrealized_pl", "portfolio_value"
    )


@query(
    "landed_trades",
    "SRC-11",
    """SELECT CAST(l_suppkey AS VARCHAR) AS account_id, CAST(l_partkey AS VARCHAR) AS symbol, l_quantity AS qty, CASE WHEN l_linestatus = 'F' THEN
    round(l_extendedprice * (l_discount - l_tax), 4) END AS realized_pl FROM lineitem""",
    "qty realized_pl",
)
def landed_trades(spark, sf):
    path = scratch_path(spark, "trades")
    made = b.trades(spark, sf)
    made.select("account_id", "symbol", F.col("l_quantity").alias("qty"), "date", "layer", "realized_pl").write.json(path)
    # A broken line for each account, which the reader has to drop.
    made.select("account_id").distinct().select(F.concat(F.lit('{"account_id": '), "account_id").alias("value")).write.mode("append").option("compression", "none").text(path)
    return rd.read_trade_logs(spark, path, wholetext=False).select("account_id", "symbol", "qty", "realized_pl")


@query(
    "landed_run_log",
    "SRC-12 SNK-4",
    """SELECT phase, severity, count(*) AS n, (SELECT count(*) FROM events WHERE value < 1) AS malformed FROM (SELECT event_type AS phase, CASE event_type WHEN
    'error' THEN 'ERROR' ELSE 'INFO' END AS severity FROM events) GROUP BY 1, 2""",
)
def landed_run_log(spark, sf):
    path = scratch_path(spark, "run-log")
    ev = b.table(spark, sf, "events")
    entries = ev.select(
        F.col("ts").cast("string").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"),
        F.col("event_type").alias("phase"), F.from_json("props", "MAP<STRING,STRING>").alias("details"),
    )
    sk.append_run_log(entries, path)
    ev.where(F.col("value") < 1).select(F.concat(F.lit('{"ts": "'), "event_id").alias("value")).write.mode("append").text(path)
    good, bad = rd.read_run_log(spark, path)
    # The count of malformed lines is a single row.
    return good.groupBy("phase", "severity").agg(F.count("*").alias("n")).join(F.broadcast(bad))


@query(
    "history_round_trip",
    "SRC-14 SNK-2",
    compose(
        """SELECT asset_id, CAST(price_date AS VARCHAR) AS obs_date, close AS value FROM prices QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY price_date
        DESC) <= 52""",
        "prices",
    ),
    "value",
)
def history_round_trip(spark, sf):
    cards = sg.nest_cards(b.prices(spark, sf), ["asset_id"], "price_date", "close")
    return rd.explode_history(cards, "asset_id")


@query(
    "series_without_history",
    "SRC-14",
    """SELECT CAST(c_custkey AS VARCHAR) AS account FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)""",
)
def series_without_history(spark, sf):
    big = b.table(spark, sf, "orders").where(F.col("o_totalprice") > 100000).select(
        F.col("o_custkey").cast("string").alias("account"), F.col("o_orderdate").cast("date").alias("obs_date"), F.col("o_totalprice").alias("value")
    )
    cards = sg.nest_cards(big, ["account"])
    wanted = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("account"))
    return rd.without_history(cards, wanted, "account")


@query(
    "dated_and_latest",
    "SNK-1",
    compose(
        """SELECT asset_id, max(close) AS high, '2024-01-30' AS run_date FROM prices WHERE price_date < DATE '1999-01-01' GROUP BY 1""", "prices"
    ),
    "high",
)
def dated_and_latest(spark, sf):
    path = scratch_path(spark, "dated")
    prices = b.prices(spark, sf)
    high = lambda rows: rows.groupBy("asset_id").agg(F.max("close").alias("high"))
    sk.write_dated(high(prices), path, "2024-01-29")
    sk.write_dated(high(prices), path, "2024-01-30")
    sk.write_dated(high(prices.where(F.col("price_date") < "1999-01-01")), path, "2024-01-30")
    return sk.read_latest(spark, path)


@query(
    "history_upsert",
    "SNK-3",
    compose(
        """SELECT entity_id, week, coalesce(n.regime, o.regime) AS regime, coalesce(o.confidence, 'Backfilled') AS confidence, coalesce(n.x, o.x) AS x FROM
        (SELECT entity_id, isoyear(month) || '-W' || lpad(CAST(week(month) AS VARCHAR), 2, '0') AS week, regime_8 AS regime, growth_score AS x FROM regimes WHERE
        month >= DATE '1998-01-01') n FULL JOIN (SELECT entity_id, isoyear(month) || '-W' || lpad(CAST(week(month) AS VARCHAR), 2, '0') AS week, regime, 'High' AS
        confidence, -9.0::DOUBLE AS x FROM regimes WHERE month < DATE '1999-01-01') o USING (entity_id, week)""",
        "regimes",
    ),
    "x",
)
def history_upsert(spark, sf):
    table = materialise(regimes(spark, sf), "regimes").select("entity_id", "month", dates.iso_week(F.col("month")).alias("week"), "regime", "regime_8", "growth_score")
    new = table.where(F.col("month") >= "1998-01-01").select("entity_id", "week", F.col("regime_8").alias("regime"), F.col("growth_score").alias("x"))
    old = table.where(F.col("month") < "1999-01-01").select("entity_id", "week", "regime", F.lit("High").alias("confidence"), F.lit(-9.0).alias("x"))
    return sk.upsert_history(old, new, ["entity_id", "week"], {"confidence": "Backfilled"})


@query(
    "landed_templates",
    "SRC-15",
    """SELECT p_type AS family, p_brand AS bucket, p_brand AS symbol, n * 1.0::DOUBLE AS weight, total * 1.0::DOUBLE AS total, abs(sum(n) OVER (PARTITION BY p_type) - total) < 0.5
    AS matches FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) JOIN (SELECT p_type, count(*) + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS total FROM
    part GROUP BY 1) USING (p_type)""",
    "weight total",
)
def landed_templates(spark, sf):
    buckets = b.table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    entry = F.to_json(F.struct(F.col("p_brand").alias("etf"), F.col("n").alias("weight")))
    # One document per family; a family has as many buckets as there are brands.
    body = F.array_join(F.collect_list(F.concat(F.lit('"'), "p_brand", F.lit('": '), entry)), ", ")
    total = F.sum("n") + F.max(F.when(F.col("p_type") == "PROMO", 1).otherwise(0))
    docs = buckets.groupBy("p_type").agg(body.alias("body"), total.cast("string").alias("total"))
    text = F.concat(F.lit('{"_note": "x", "'), "p_type", F.lit('": {"_description": "d", '), "body", F.lit(', "_total": '), "total", F.lit("}}"))
    rows, totals = rd.read_templates(spark, _landed(docs.select(text.alias("value")), "templates"), wholetext=False)
    return rows.join(totals.select("family", "total", "matches"), "family")


@query(
    "safe_doubles",
    "SC-20",
    r"""SELECT page_id, try_cast(regexp_extract(url, '^https?://[^/]+/[^/]*/([^/?#]*)', 1) AS DOUBLE) AS parsed FROM pages""",
    "parsed",
)
def safe_doubles(spark, sf):
    part = F.regexp_extract("url", r"^https?://[^/]+/[^/]*/([^/?#]*)", 1)
    return b.table(spark, sf, "pages").select("page_id", part.try_cast("double").alias("parsed"))
