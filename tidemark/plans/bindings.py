"""The operators' input tables, derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import dates
from tidemark.operators.scans import running
from tidemark.session import FREED, materialise


#: Declared schemas: a scan then needs no job to read footers first.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


def entity_orders(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """Orders with the entity of their customer: the nation, or its region."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    if entity == "region":
        nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        cust = cust.join(nation, "c_nationkey").select("o_custkey", F.col("n_regionkey").cast("string").alias("entity_id"))
    else:
        cust = cust.select("o_custkey", F.col("c_nationkey").cast("string").alias("entity_id"))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("o_date"),
    )
    return orders.join(cust, "o_custkey")


def entity_lines(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """Line items with the entity of their order."""
    keyed = entity_orders(spark, sf, entity).select(F.col("o_orderkey").alias("l_orderkey"), "entity_id")
    lines = table(spark, sf, "lineitem").select("*", F.col("l_shipdate").cast("date").alias("day"))
    return lines.join(keyed, "l_orderkey")


def observations(spark: SparkSession, sf: str, entity: str = "nation") -> DataFrame:
    """Nine series per entity: flows dated on month ends, averages per day."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    core = F.col("l_returnflag") != "R"
    hundredths = lambda c: F.round(F.col(c) * 100).cast("bigint")
    daily = (
        entity_lines(spark, sf, entity)
        .groupBy("entity_id", "day")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.sum("l_extendedprice").alias("price"),
            F.count("*").alias("n"),
            F.sum(hundredths("l_discount")).alias("disc"),
            F.sum(hundredths("l_tax")).alias("tax"),
            F.sum(unit).alias("unit"),
            F.sum(F.when(core, unit)).alias("core_unit"),
            F.count(F.when(core, 1)).alias("core_n"),
        )
    )
    # One pass over the daily table: flows land on month ends and add up, daily rates are sums of a single value.
    long = (
        daily.selectExpr(
            "entity_id",
            """stack(7, 'INDPRO', last_day(day), qty, 'M2SL', last_day(day), price, 'WALCL', last_day(day), cast(n AS DOUBLE),
            'UNRATE', day, disc / n, 'NFCI', day, tax / n, 'CPIAUCSL', day, round(unit / n, 6),
            'CPILFESL', day, round(try_divide(core_unit, core_n), 6)) AS (series_id, obs_date, value)""",
        )
        .where("value IS NOT NULL")
        .groupBy("entity_id", "series_id", "obs_date")
        .agg(F.sum("value").alias("value"))
        .withColumn("value", F.when(F.col("series_id") == "M2SL", F.round("value", 2)).otherwise(F.col("value")))
    )
    orders = (
        entity_orders(spark, sf, entity)
        .groupBy("entity_id", F.last_day("o_date").alias("obs_date"))
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("sales"),
            F.countDistinct("o_custkey").cast("double").alias("active"),
        )
        .selectExpr("entity_id", "stack(2, 'RSAFS', sales, 'PAYEMS', active) AS (series_id, value)", "obs_date")
    )
    return long.unionByName(orders.select("entity_id", "series_id", "obs_date", "value"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Daily close and volume per brand."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset_id"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf, "lineitem")
        .join(part, "l_partkey")
        .groupBy("asset_id", F.col("l_shipdate").cast("date").alias("price_date"))
        .agg(F.round(F.sum(unit) / F.count("*"), 6).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))
    )


def entity_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Daily close per entity and product type: the assets traded in each entity."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("asset_id"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        entity_lines(spark, sf)
        .join(part, "l_partkey")
        .groupBy("entity_id", "asset_id", F.col("day").alias("price_date"))
        .agg(F.round(F.sum(unit) / F.count("*"), 6).alias("close"))
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with account, day and second-precision order."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("account_id"),
        "event_id",
        "ts",
        F.col("ts").cast("date").alias("day"),
        "event_type",
        "value",
        "props",
    )


def weekly_history(spark: SparkSession, sf: str) -> DataFrame:
    """Per account and ISO week: most frequent event type as the family, with two divergence marks."""
    counted = (
        events(spark, sf)
        .groupBy("account_id", dates.iso_week(F.col("day")).alias("week"), dates.week_index(F.col("day")).alias("week_no"), "event_type")
        .agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.sum("value").alias("v"))
    )
    weekly = counted.groupBy("account_id", "week", "week_no").agg(
        F.max_by("event_type", F.struct("n", "event_type")).alias("family"),
        F.sum("n").alias("n_events"),
        F.max("last_event").alias("last_event"),
        F.max("n").alias("_top"),
        F.round(F.sum("v"), 2).alias("_v"),
    )
    return weekly.select(
        "account_id", "week", "week_no", "family", "n_events", "last_event",
        (F.col("_top") * 2 < F.col("n_events")).alias("diverged"),
        (F.col("_v") < 200).alias("liquidity_diverged"),
    )


def net_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly long, short and net quantity per contract (brand): finished lines are long, open ones short."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("contract"))
    side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")).otherwise(0.0))
    week = F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date")
    weekly = table(spark, sf, "lineitem").join(part, "l_partkey").groupBy("contract", week.alias("week")).agg(
        side("F").alias("long_qty"), side("O").alias("short_qty")
    )
    return weekly.select("*", (F.col("long_qty") - F.col("short_qty")).alias("net"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Portfolio value per account after each event: 100 000 plus the running sum of signed values."""
    kind, value = F.col("event_type"), F.col("value")
    signed = F.when(kind.isin("purchase", "signup"), value).when(kind == "error", -value).otherwise(0.0)
    ev = events(spark, sf).select("account_id", "event_id", "ts", "day", signed.alias("signed"))
    summed = running(ev, ["account_id"], event_order(), F.col("day"), {"_s": ("sum", F.col("signed"))})
    return summed.select("account_id", "event_id", "ts", "day", F.round(F.col("_s") + 100000, 2).alias("portfolio_value"))


def event_order() -> list:
    """Numeric order of events within an account."""
    return [F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")]


LINE_ORDER = ["_day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades; open lines have no realised result."""
    pl = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("account_id"),
        F.col("l_partkey").cast("string").alias("symbol"),
        F.when(flag == "A", "regime").when(flag == "N", "thesis_tactical").alias("layer"),
        F.col("l_linestatus").alias("mechanism"),
        F.when(flag == "N", F.concat(F.lit("thesis "), F.col("l_linenumber"))).otherwise("").alias("thesis"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_linestatus") == "F", F.round(pl, 4)).alias("realized_pl"),
        F.unix_date(F.col("l_shipdate").cast("date")).alias("_day"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount",
    )


def fx(spark: SparkSession, sf: str) -> DataFrame:
    """Exchange rates of nation currencies: direct, inverse or against USD by region; some have none."""
    n = table(spark, sf, "nation")
    k, name, region = F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")
    row = lambda s, d, r: F.struct(s.alias("src"), d.alias("dst"), r.alias("rate"))
    base, usd = F.lit("BASE"), F.lit("USD")
    own = (
        F.when(region == 0, row(name, base, 1 + k / 10))
        .when(region == 1, row(base, name, 2 + k / 10))
        .when(region == 2, row(name, usd, 0.5 + k / 10))
    )
    bridge = F.when(k == 0, row(usd, base, F.lit(1.25)))
    return n.select(F.inline(F.array_compact(F.array(own, bridge))))


def holdings(spark: SparkSession, sf: str, priorities: tuple[str, ...] | None = None) -> DataFrame:
    """Holdings per customer and part; large parts are funds with weight maps, middling ones bonds."""
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    cust = table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("o_custkey"), "n_name", "r_name", "c_acctbal"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    if priorities:
        orders = orders.where(F.col("o_orderpriority").isin(list(priorities)))
    lots = (
        table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", F.col("l_partkey").alias("p_partkey"))
        .agg(F.sum("l_quantity").alias("qty"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"))
    )
    size = F.col("p_size")
    fund = size > 40
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_retailprice").alias("price"),
        size.alias("size"),
        F.when(size <= 30, "equities").when(size <= 40, "bonds").otherwise("fund").alias("asset_class"),
        F.when(size <= 30, F.col("p_type")).alias("sector"),
        F.when(fund, F.create_map(F.lit("technology"), F.lit(0.6), F.lit("energy"), size / 200, F.lit("utilities"), F.lit(0.0))).alias(
            "sector_weightings"
        ),
        F.when(fund, F.create_map(F.lit("stockPosition"), size / 100, F.lit("bondPosition"), 1 - size / 100)).alias("asset_classes"),
        F.when(size % 3 == 0, "regime").when(size % 3 == 1, "thesis_tactical").otherwise("thesis_structural").alias("layer"),
        F.when(size % 3 == 0, "").otherwise(F.col("p_brand")).alias("thesis"),
    )
    return (
        lots.join(part, "p_partkey")
        .join(cust, "o_custkey")
        .select(
            F.col("o_custkey").cast("string").alias("account_id"),
            F.col("p_partkey").cast("string").alias("symbol"),
            "qty", "price", "entry_price",
            F.col("n_name").alias("currency"), F.col("r_name").alias("geography"),
            "sector", "asset_class", "sector_weightings", "asset_classes", "layer", "thesis", "size",
            F.col("c_acctbal").alias("cash"),
        )
    )


def positions(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Positions with results and the share of their account's value (cash included), or the columns ``cols`` of them.

    Only what the columns need is written, and nothing where no account total is among them.
    """
    held = holdings(spark, sf).select(
        "account_id", "symbol", "qty", F.col("price").alias("current_price"), F.col("entry_price").alias("avg_entry_price"),
        (F.col("price") * F.col("qty")).alias("market_value"),
        ((F.col("price") - F.col("entry_price")) * F.col("qty")).alias("unrealized_pl"),
        ((F.col("price") - F.col("entry_price")) / F.col("entry_price")).alias("unrealized_plpc"),
        (F.col("price") * F.col("qty") * (F.col("size") - 25) / 1000).alias("change_today"),
        "layer", "thesis", "sector", "cash", "size",
    )
    if cols and not {"portfolio_value", "allocation_pct"} & {*cols}:
        return held.select(*cols)
    needed = [c for c in held.columns if not cols or c in (*cols, "account_id", "market_value", "cash")]
    held = materialise(held.select(*needed), "positions", FREED)
    total = held.groupBy("account_id").agg((F.sum("market_value") + F.max("cash")).alias("portfolio_value"))
    shared = held.join(total, "account_id").select("*", (F.col("market_value") / F.col("portfolio_value") * 100).alias("allocation_pct"))
    return shared.select(*cols) if cols else shared


def thesis_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One Markdown document per order: metadata, summary, numbered assumptions, a pipe table and sector prose."""
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"
    )
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    docs = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    text = lambda c: c.cast("string")
    whole = lambda c: F.floor(c).cast("bigint").cast("string")
    state = lambda x: F.when(x["l_linestatus"] == "F", "INTACT").otherwise("UNDER PRESSURE")
    item = F.transform(
        "ls",
        lambda x, i: F.concat(
            text(i + 1), F.lit(". Part "), text(x["l_partkey"]), F.lit(" holds $"), whole(x["l_extendedprice"]), F.lit("K and "),
            whole(x["l_discount"] * 100), F.lit("% — Testable by: review "), text(x["l_suppkey"]),
            F.lit(". Current status: "), state(x), F.lit("\n   - volume "), whole(x["l_quantity"]), F.lit(" tonnes"),
        ),
    )
    etf = lambda x: F.when(x["l_returnflag"] == "R", "SPY / EUR").when(x["l_returnflag"] == "A", "GLD").otherwise("")
    row = F.transform(
        "ls",
        lambda x: F.concat(
            F.lit("| **Part "), text(x["l_partkey"]), F.lit("** | "),
            F.when(x["l_discount"] > 0.05, "strong overweight").when(x["l_discount"] > 0.02, "neutral").otherwise("avoid"),
            F.lit(" | "), etf(x), F.lit(" | Held with TLT for "), whole(x["l_quantity"]), F.lit(" weeks |"),
        ),
    )
    prose = F.transform(
        "ls",
        lambda x: F.concat(
            F.when(x["l_returnflag"] == "R", "**Energy (").when(x["l_returnflag"] == "A", "**Basic Materials (").otherwise("**Utilities ("),
            F.when(x["l_linestatus"] == "F", "Overweight").otherwise("Neutral"),
            F.lit("):** Body of XLE part "), text(x["l_partkey"]), F.lit(". **Reassessment trigger:** price above "),
            whole(x["l_quantity"]), F.lit(". "),
        ),
    )
    level = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "High (tactical)").when(F.col("o_orderpriority") == "2-HIGH", "medium-high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").otherwise("")
    )
    n = F.size("ls")
    return docs.select(
        F.col("o_orderkey").alias("doc_id"),
        "o_custkey",
        F.concat(
            F.when(F.col("o_orderpriority") == "1-URGENT", "# STRUCTURAL THESIS: Order ").otherwise("# THESIS: Order "), text(F.col("o_orderkey")),
            F.lit("\n**Status:** "), F.when(F.col("o_orderstatus") == "F", "Active since start").otherwise("DRAFT"),
            F.when(level != "", F.concat(F.lit("\n**Conviction:** "), level)).otherwise(""),
            F.lit("\n\n## Summary\nWe buy SPY and **XLE** here. Regime: Stagflation — "),
            F.when(n % 2 == 0, "Ample").otherwise("Tight"), F.lit(" Liquidity. Growth score: 0."), text(n),
            F.lit(", Inflation axis: -"), text(n), F.lit(".5, "), text(n),
            F.lit(" consecutive weeks of Stagflation. Confidence: High\n## What Has To Stay True\n"), F.array_join(item, "\n"),
            F.lit("\n## The Trade\n| Asset | Direction | ETF | Rationale |\n|---|:---|---|---|\n"), F.array_join(row, "\n"),
            F.lit("\n\n## Sector View\n"), F.array_join(prose, ""),
        ).alias("text"),
    )


def earlier_assumptions(spark: SparkSession, sf: str, kept: Column) -> DataFrame:
    """The assumptions of an earlier version of :func:`thesis_docs`, with lines that are ``kept`` alone and statuses by return flag."""
    lines = table(spark, sf, "lineitem")
    whole = lambda c: F.floor(c).cast("bigint").cast("string")
    status = F.when(F.col("l_returnflag") == "R", "INTACT").otherwise("UNDER PRESSURE")
    item = F.concat(
        F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" holds $"), whole(F.col("l_extendedprice")), F.lit("K and "),
        whole(F.col("l_discount") * 100), F.lit("% — Testable by: review. Current status: "), status,
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    entry = F.struct(order.alias("at"), kept.alias("kept"), F.struct(item.alias("text"), status.alias("status")).alias("a"))
    listed = F.filter(F.sort_array(F.collect_list(entry)), lambda e: e["kept"])
    return lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(listed, lambda e: e["a"]).alias("assumptions"))


def contested_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One Markdown document per order: what speaks against it, a risk per line, and a view of each line's supplier."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(line)).alias("ls"))
    text = lambda c: c.cast("string")
    whole = lambda c: F.floor(c).cast("bigint").cast("string")
    risk = lambda x: F.concat(
        F.lit("\n- **Key risk "), text(x["l_linenumber"]), F.lit(":** Part "), text(x["l_partkey"]), F.lit(" **fails**"),
        F.when(x["l_returnflag"] == "R", F.concat(F.lit(". Probability: "), whole(x["l_quantity"]), F.lit(".5% a year. Watch it"))).otherwise("\n  and stays so"),
    )
    view = lambda x: F.when(x["l_linestatus"] == "F", F.concat(
        F.lit("\n### 2024-01-15 — Supplier "), text(x["l_suppkey"]), F.lit("\n- Quote: We **hold** "), whole(x["l_quantity"]),
        F.lit(" tonnes\n  until sold\n- Thesis alignment: Supports"),
    )).otherwise(F.concat(F.lit("\n**Supplier "), text(x["l_suppkey"]), F.lit(":** is doubtful.\n- **Thesis alignment:** Challenges at 2.5%")))
    return docs.select("doc_id", F.concat(
        F.lit("# THESIS\n\n## What Could Break It\n"),
        F.when(F.size("ls") % 2 == 0, "**Strongest counter-argument:** ").otherwise(""),
        F.lit("Demand falls by 2.5%.\n\n"), F.array_join(F.transform("ls", risk), ""),
        F.lit("\n- **Assessment after considering contrarian case:** Medium\n\n## External Views\nAs told."),
        F.array_join(F.transform("ls", view), ""), F.lit("\n\n## The Trade\nBuy."),
    ).alias("text"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as run-log entries, one run per account."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    text = k.cast("string")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"),
        F.col("ts").cast("string").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "ERROR").when(kind == "click", "WARN").otherwise("INFO").alias("severity"),
        F.when(kind == "signup", "run-start").when(kind == "purchase", "run-end").otherwise(kind).alias("phase"),
        F.when(k < 10, F.concat(F.lit("Timeout after "), text)).when(k < 20, F.concat(F.lit("retry "), text))
        .when(k < 30, F.concat(F.lit("script failed: exit code "), text)).when(k < 40, F.concat(F.lit("Data gap "), text)).otherwise("ok").alias("message"),
        F.when(kind == "signup", "IN_PROGRESS").when((kind == "purchase") & (k > 60), "COMPLETE").alias("status"),
    )
