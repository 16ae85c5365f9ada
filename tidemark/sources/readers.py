"""Readers of landed files. Formats with data-dependent keys are parsed with map schemas, never by inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import schema


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Long series files with missing values dropped; NaN counts as missing."""
    raw = spark.read.schema(schema.OBSERVATIONS).options(**options).format(fmt).load(path)
    return raw.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).dropna(subset=["value"])


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Close and volume per asset and date; rows without a close are dropped."""
    raw = spark.read.schema(schema.PRICES).options(**options).format(fmt).load(path)
    return raw.withColumn("close", F.nanvl("close", F.lit(None).cast("double"))).dropna(subset=["close"])


def _documents(spark: SparkSession, path: str, wholetext: bool) -> DataFrame:
    """One row per JSON document: a whole file, or a line of a file."""
    return spark.read.text(path, wholetext=wholetext).select("value")


_DIMENSION = "ARRAY<STRUCT<id: STRING, values: ARRAY<STRUCT<id: STRING>>>>"
_SDMX_BODY = (
    f"structure: STRUCT<dimensions: STRUCT<series: {_DIMENSION}, observation: {_DIMENSION}>>, "
    "dataSets: ARRAY<STRUCT<series: MAP<STRING, STRUCT<observations: MAP<STRING, ARRAY<DOUBLE>>>>>>"
)


def read_sdmx_json(spark: SparkSession, path: str, area_dim: str = "REF_AREA", wholetext: bool = True, sort_periods: bool = False) -> DataFrame:
    """Area, period and value of an SDMX-JSON document, whose keys are positions in its dimension lists."""
    parsed = _documents(spark, path, wholetext).select(F.from_json("value", f"STRUCT<data: STRUCT<{_SDMX_BODY}>, {_SDMX_BODY}>").alias("d"))
    part = lambda name: F.coalesce(F.col(f"d.data.{name}"), F.col(f"d.{name}"))

    def values(dims: Column, name: str) -> Column:
        found = F.filter(dims, lambda x: x["id"] == name)
        return F.transform(F.get(found, F.lit(0))["values"], lambda v: v["id"])

    dims = part("structure")["dimensions"]
    periods = values(dims["observation"], "TIME_PERIOD")
    series = parsed.select(
        values(dims["series"], area_dim).alias("areas"),
        (F.array_sort(periods) if sort_periods else periods).alias("periods"),
        F.explode(F.get(part("dataSets"), F.lit(0))["series"]).alias("key", "s"),
    )
    rows = series.select("periods", F.get("areas", F.split("key", ":")[0].cast("int")).alias("area"), F.explode("s.observations").alias("idx", "obs"))
    return rows.select("area", F.get("periods", F.col("idx").cast("int")).alias("period"), F.get("obs", F.lit(0)).alias("value")).dropna()


def read_json_stat(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Period and value of a JSON-stat document: the period's index looks up the value map."""
    parsed = _documents(spark, path, wholetext).select(
        F.from_json(
            "value",
            "STRUCT<label: STRING, value: MAP<STRING, DOUBLE>, dimension: STRUCT<time: STRUCT<category: STRUCT<index: MAP<STRING, INT>>>>>",
        ).alias("d")
    )
    rows = parsed.select(F.col("d.label").alias("label"), F.col("d.value").alias("v"), F.explode("d.dimension.time.category.index").alias("period", "idx"))
    return rows.select("label", "period", F.try_element_at("v", F.col("idx").cast("string")).alias("value")).dropna(subset=["value"])


def read_bulk_series(spark: SparkSession, path: str, ids: Sequence[str], last: int | None = None) -> DataFrame:
    """Wanted series of a bulk file with one JSON series per line, newest first.

    A plain substring test drops the other lines before any JSON is parsed; trimming happens inside the row.
    """
    lines = spark.read.text(path)
    wanted = F.lit(False)
    for i in ids:
        wanted = wanted | F.col("value").contains(i)
    parsed = lines.where(wanted).select(F.from_json("value", "STRUCT<series_id: STRING, data: ARRAY<ARRAY<STRING>>>").alias("d"))
    points = F.filter(F.col("d.data"), lambda p: (F.size(p) >= 2) & F.get(p, F.lit(1)).try_cast("double").isNotNull())
    kept = F.slice(points, 1, last) if last else points
    rows = parsed.where(F.col("d.series_id").isin(list(ids))).select(F.col("d.series_id").alias("series_id"), F.explode(kept).alias("p"))
    return rows.select("series_id", F.to_date(F.col("p")[0], "yyyyMMdd").alias("obs_date"), F.col("p")[1].try_cast("double").alias("value"))


def read_coded_csv(spark: SparkSession, path: str, filters: dict[str, str], keys: Sequence[str], value: str = "OBS_VALUE") -> DataFrame:
    """Rows of a coded CSV that match every filter; values that do not parse are dropped."""
    raw = spark.read.option("header", True).csv(path)
    for column, code in filters.items():
        raw = raw.where(F.col(column) == code)
    return raw.select(*keys, F.col(value).try_cast("double").alias("value")).dropna(subset=["value"])


def net_positions(wide: DataFrame, contracts: dict[str, tuple[str, str]], contract: str = "contract", date: str = "report_date") -> DataFrame:
    """Net position per contract and date from the long and short columns its metadata names; missing counts as zero."""
    columns = sorted({c for pair in contracts.values() for c in pair})
    side = F.create_map(
        *[x for k, (lo, sh) in contracts.items() for x in (F.lit(f"{k}|{lo}"), F.lit(1.0), F.lit(f"{k}|{sh}"), F.lit(-1.0))]
    )
    long = wide.unpivot([contract, date], columns, "column", "quantity")
    sign = F.try_element_at(side, F.concat_ws("|", contract, "column"))
    return (
        long.select(contract, date, sign.alias("sign"), F.coalesce(F.col("quantity").try_cast("double"), F.lit(0.0)).alias("quantity"))
        .where(F.col("sign").isNotNull())
        .groupBy(contract, date)
        .agg(F.sum(F.when(F.col("sign") > 0, F.col("quantity"))).alias("long_qty"), F.sum(F.when(F.col("sign") < 0, F.col("quantity"))).alias("short_qty"))
        .select("*", (F.coalesce("long_qty", F.lit(0.0)) - F.coalesce("short_qty", F.lit(0.0))).alias("net"))
    )


def read_country_years(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Indicator, country, year and value of a three-level nested document."""
    parsed = _documents(spark, path, wholetext).select(
        F.from_json("value", "STRUCT<values: MAP<STRING, MAP<STRING, MAP<STRING, DOUBLE>>>>").alias("d")
    )
    countries = parsed.select(F.explode("d.values").alias("indicator", "c")).select("indicator", F.explode("c").alias("country", "y"))
    return countries.select("indicator", "country", F.explode("y").alias("year", "value")).select(
        "indicator", "country", F.col("year").cast("int").alias("year"), "value"
    )


def read_meta_records(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Records of ``[meta, records]`` documents, with whether the document says there are more pages."""
    parts = _documents(spark, path, wholetext).select(F.from_json("value", "ARRAY<STRING>").alias("a"))
    rows = parts.select(
        F.coalesce(F.from_json(F.get("a", F.lit(0)), "STRUCT<pages: INT>")["pages"] > 1, F.lit(False)).alias("truncated"),
        F.explode(F.from_json(F.get("a", F.lit(1)), "ARRAY<STRUCT<country: STRUCT<id: STRING>, date: STRING, value: DOUBLE>>")).alias("r"),
    )
    return rows.select(F.col("r.country.id").alias("country"), F.col("r.date").cast("int").alias("year"), F.col("r.value").alias("value"), "truncated").dropna(
        subset=["value"]
    )


def read_snapshots(spark: SparkSession, path: str, glob: str = "*-snapshot.json", wholetext: bool = True) -> DataFrame:
    """Dated portfolio snapshots of a folder, a file or a line each; copies named ``latest-`` are left out."""
    raw = spark.read.schema(schema.SNAPSHOT).option("multiLine", wholetext).option("pathGlobFilter", glob).json(path)
    named = raw.select("*", F.col("_metadata.file_name").alias("file"))
    return named.where(~F.col("file").startswith("latest-"))


def account_tables(snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accounts, positions without results, and positions with results; decisions read only the first two."""
    keys = [F.col("account.account_id").alias("account_id"), F.col("timestamp").cast("timestamp").alias("ts")]
    accounts = snapshots.select(*keys, "account.portfolio_value", "account.cash", "account.buying_power")
    rows = snapshots.select(*keys, F.explode("positions").alias("p"))
    plain = rows.select("account_id", "ts", *[f"p.{c}" for c in ("symbol", "qty", "side", "market_value", "current_price", "avg_entry_price")])
    results = rows.select("account_id", "ts", "p.symbol", *[f"p.{c}" for c in ("unrealized_pl", "unrealized_plpc", "change_today")])
    return accounts, plain, results


def read_trade_logs(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Trades of files that hold one object or a list of them, or of lines; what does not parse is dropped."""
    raw = spark.read.schema(f"{schema.TRADES}, _bad STRING").option("multiLine", wholetext).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull()).drop("_bad")


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good entries of a JSON-lines log and a one-row count of malformed lines."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(F.from_json("value", f"{schema.RUN_LOG}, _bad STRING", options).alias("e"))
    good = parsed.where(F.col("e._bad").isNull()).select("e.*").drop("_bad")
    return good, parsed.agg(F.count(F.when(F.col("e._bad").isNotNull(), 1)).alias("malformed"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One whole text per file, named by its stem, or by the folder ``doc_id=...`` that it lies in."""
    raw = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return raw.select((F.col("doc_id").cast("string") if "doc_id" in raw.columns else stem).alias("doc_id"), F.col("value").alias("text"))


def explode_history(cards: DataFrame, key: str, history: str = "history") -> DataFrame:
    """Observation rows of nested cards."""
    return cards.select(key, F.inline(history)).select(key, F.col("date").alias("obs_date"), "value")


def without_history(cards: DataFrame, wanted: DataFrame, key: str, history: str = "history") -> DataFrame:
    """Wanted series that have no card or an empty one."""
    return wanted.select(key).join(cards.where(F.size(history) > 0).select(key), key, "left_anti")


def read_templates(spark: SparkSession, path: str, wholetext: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (family, bucket, symbol, weight) of a nested template document, and whether each family meets its total."""
    parsed = _documents(spark, path, wholetext).select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("family", "body"))
    outer = parsed.where(~F.col("family").startswith("_")).select("family", F.from_json("body", "MAP<STRING, STRING>").alias("b"))
    entries = outer.select("family", F.explode("b").alias("bucket", "raw"))
    leaf = F.from_json("raw", "STRUCT<etf: STRING, weight: DOUBLE, pct: DOUBLE>")
    rows = entries.where(~F.col("bucket").startswith("_")).select(
        "family", "bucket", leaf["etf"].alias("symbol"), F.coalesce(leaf["weight"], leaf["pct"], F.col("raw").try_cast("double")).alias("weight")
    ).dropna(subset=["weight"])
    totals = entries.where(F.col("bucket") == "_total").select("family", F.col("raw").try_cast("double").alias("total"))
    checked = rows.groupBy("family").agg(F.sum("weight").alias("weight")).join(totals, "family", "left")
    return rows, checked.select("*", (F.abs(F.col("weight") - F.col("total")) < 0.5).alias("matches"))
