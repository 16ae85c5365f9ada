"""Registered queries: streams. The events table arrives in parts; each job runs on what has arrived and resumes from its
checkpoint, and must end with the rows of its batch twin. For jobs that correct earlier rows every tenth event comes late."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.streaming import jobs, state

CUT = "2024-01-16"
CUTS = ("2024-01-11", "2024-01-21")


def _arrivals(spark, table, label, start):
    """Land ``table`` in two steps (before and from ``CUT``) and call ``start(stream, checkpoint)`` after each."""
    root = scratch_path(spark, label)
    landing, checkpoint = f"{root}/landing", f"{root}/checkpoint"
    early = F.col("day") < F.lit(CUT).cast("date")
    for part in (table.where(early), table.where(~early)):
        part.write.mode("append").parquet(landing)
        start(spark.readStream.schema(table.schema).parquet(landing), checkpoint)
    return root


def _late_arrivals(spark, table, label, late, start):
    """Land ``table`` in three parts cut at ``CUTS``, where rows for which ``late`` holds come a day after their event, and
    call ``start(stream, checkpoint)`` after each. The log of updates in ``out`` is returned."""
    root = scratch_path(spark, label)
    comes = F.date_add("day", late.cast("int"))
    part = sum((comes >= F.lit(cut).cast("date")).cast("int") for cut in CUTS)
    for i in range(len(CUTS) + 1):
        table.where(part == i).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", 1 << 29).parquet(f"{root}/landing")
        jobs.run_available(start(stream), jobs.updates_job(f"{root}/updates"), f"{root}/checkpoint", "append")
    return f"{root}/updates"


def _events(spark, sf):
    return b.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_baseline",
    "STR-1",
    """SELECT account_id, event_type, CAST(day AS VARCHAR) AS day, value, count(value) OVER q AS baseline_n, CASE WHEN count(value) OVER q >= 5 AND
    stddev_pop(value) OVER q > 1e-6 THEN (value - avg(value) OVER q) / stddev_pop(value) OVER q END AS z FROM (SELECT CAST(user_id AS VARCHAR) AS account_id,
    event_type, CAST(ts AS DATE) AS day, round(sum(value), 2) AS value FROM events GROUP BY 1, 2, 3) WINDOW q AS (PARTITION BY account_id, event_type ORDER BY day
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "value z",
)
def stream_baseline(spark, sf):
    keys = ["account_id", "event_type"]
    daily = b.events(spark, sf).groupBy(*keys, "day").agg(F.round(F.sum("value"), 2).alias("value"))
    late = F.pmod(F.xxhash64(*keys, "day"), F.lit(10)) == 0
    out = _late_arrivals(spark, daily, "baseline", late, lambda stream: state.baseline(stream, keys, "day", "value", min_n=5))
    rows = jobs.current_rows(spark, out, [*keys, state.MS])
    return rows.select(*keys, F.timestamp_millis(state.MS).cast("date").alias("day"), "value", "baseline_n", "z")


cte(
    "daily_labels",
    """SELECT CAST(user_id AS VARCHAR) AS account_id, CAST(ts AS DATE) AS day, arg_max(event_type, (n, event_type)) AS label FROM (SELECT user_id, CAST(ts AS DATE)
    AS ts, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)


@query(
    "stream_confirmation",
    "STR-2",
    compose(
        """SELECT account_id, CAST(day AS VARCHAR) AS day, label, last_value(anchor IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS
        confirmed FROM (SELECT *, CASE WHEN lag(label) OVER a IS NULL OR label = lag(label) OVER a THEN label END AS anchor FROM daily_labels WINDOW a AS (PARTITION BY
        account_id ORDER BY day))""",
        "daily_labels",
    ),
)
def stream_confirmation(spark, sf):
    counted = b.events(spark, sf).groupBy("account_id", "day", "event_type").agg(F.count("*").alias("n"))
    labels = counted.groupBy("account_id", "day").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("label"))
    out = {}

    def start(stream, checkpoint):
        out["path"] = checkpoint.rsplit("/", 1)[0] + "/confirmed"
        jobs.run_to_files(jobs.confirmation_stream(stream, "account_id", "day", "label"), out["path"], checkpoint)

    _arrivals(spark, labels, "confirmation", start)
    return spark.read.parquet(out["path"])


@query(
    "stream_weekly_dedup",
    "STR-3",
    """SELECT account_id, week, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2,
    '0') AS week, event_id, event_type, ts FROM events) QUALIFY row_number() OVER (PARTITION BY account_id, week ORDER BY ts DESC, event_id DESC) = 1""",
)
def stream_weekly_dedup(spark, sf):
    ev = _events(spark, sf).select("account_id", dates.iso_week(F.col("day")).alias("week"), "event_id", "event_type", "ts", "day")
    table = {}

    def start(stream, checkpoint):
        table["root"] = checkpoint.rsplit("/", 1)[0] + "/table"
        jobs.run_available(stream.drop("day"), jobs.upsert_job(table["root"], ["account_id", "week"], ["ts", "event_id"], buckets=8), checkpoint)

    _arrivals(spark, ev, "dedup", start)
    return jobs.keyed_table(spark, table["root"]).drop("ts")


@query(
    "stream_bucket_last",
    "STR-4",
    """SELECT account_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS start, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM (SELECT CAST(user_id AS
    VARCHAR) AS account_id, ts, event_id, value FROM events) GROUP BY 1, 2""",
    "value",
)
def stream_bucket_last(spark, sf):
    out = {}

    def start(stream, checkpoint):
        out["path"] = checkpoint.rsplit("/", 1)[0] + "/updates"
        # Weeks start on Monday: the epoch was a Thursday, four days before one.
        buckets = jobs.bucket_last(stream, ["account_id"], "ts", "value", "event_id", "7 days", "4 days", "1 day")
        jobs.run_available(buckets, jobs.updates_job(out["path"]), checkpoint, "update")

    _arrivals(spark, _events(spark, sf), "buckets", start)
    rows = jobs.current_rows(spark, out["path"], ["account_id", "start"])
    return rows.select("account_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "value", "n")


@query(
    "stream_range_anomalies",
    "STR-5",
    """SELECT event_id, series_id, value, CASE WHEN value < lo * 0.5 OR value > hi * 2 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT event_id, value, CASE
    event_type WHEN 'view' THEN 'UNRATE' WHEN 'click' THEN 'T10YIE' ELSE '^VIX' END AS series_id FROM events) JOIN (VALUES ('UNRATE', 0.0, 30.0), ('T10YIE', -2.0, 6.0),
    ('^VIX', 5.0, 100.0)) r(series_id, lo, hi) USING (series_id) WHERE value < lo OR value > hi""",
    "value",
)
def stream_range_anomalies(spark, sf):
    from tidemark.operators import signals as sg

    kind = F.col("event_type")
    ev = b.events(spark, sf).select(
        "event_id", "day", F.when(kind == "view", "UNRATE").when(kind == "click", "T10YIE").otherwise("^VIX").alias("series_id"), F.col("value").alias("latest_value")
    )
    out = {}

    def start(stream, checkpoint):
        out["path"] = checkpoint.rsplit("/", 1)[0] + "/anomalies"
        jobs.run_to_files(sg.range_anomalies(stream), out["path"], checkpoint)

    _arrivals(spark, ev, "anomalies", start)
    return spark.read.parquet(out["path"]).select("event_id", "series_id", F.col("latest_value").alias("value"), "severity")


@query(
    "stream_drawdown",
    "STR-6",
    compose(
        """SELECT account_id, event_id, portfolio_value, high, drawdown_pct, CASE WHEN drawdown_pct >= 10 THEN 'breach' WHEN drawdown_pct >= 7 THEN 'alert' ELSE '' END AS
        level FROM snap_returns""",
        "snap_returns",
    ),
    "portfolio_value high drawdown_pct",
)
def stream_drawdown(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    signed = F.when(kind.isin("purchase", "signup"), value).when(kind == "error", -value).otherwise(0.0)
    ev = _events(spark, sf).select("account_id", "event_id", "ts", "day", signed.alias("signed"))
    late = F.pmod("event_id", F.lit(10)) == 0
    out = _late_arrivals(spark, ev, "drawdown", late, lambda stream: state.drawdown(stream, "account_id", "ts", "event_id", "signed"))
    return jobs.current_rows(spark, out, ["account_id", "event_id"]).select("account_id", "event_id", "portfolio_value", "high", "drawdown_pct", "level")


@query(
    "stream_log_sessions",
    "STR-7",
    compose(
        """SELECT run, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, events, info, warn, error, incomplete, CASE WHEN last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM
        events) - INTERVAL 2 DAY THEN 'closed' ELSE 'open' END AS status FROM (SELECT run, min(t) AS start, max(t) AS last, count(*) AS
        events, count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity = 'ERROR') AS error, NOT bool_or(phase =
        'run-end') AS incomplete FROM (SELECT *, sum(g) OVER (PARTITION BY run ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER
        (PARTITION BY run ORDER BY t, seq) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM (SELECT *, CAST(ts AS TIMESTAMP) AS t FROM runlog))) GROUP BY run, s)""",
        "runlog",
    ),
)
def stream_log_sessions(spark, sf):
    log = b.run_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.col("ts").cast("date"))
    late = F.pmod("seq", F.lit(10)) == 0
    out = _late_arrivals(spark, log, "sessions", late, lambda stream: state.log_sessions(stream, "run", "ts", 6, "2 days"))
    rows = jobs.current_rows(spark, out, ["run", "start"]).where(F.col("status") != "joined")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_win_rate",
    "STR-8",
    """SELECT event_type, strftime(d, '%Y-%m-%d') AS start, avg(CASE WHEN value > 50 THEN 100.0::DOUBLE ELSE 0 END) AS win_rate, count(*) AS n FROM (SELECT event_type,
    value, unnest([CAST(ts AS DATE) - CAST(i AS INTEGER) FOR i IN range(7)]) AS d FROM events) GROUP BY 1, 2""",
    "win_rate",
)
def stream_win_rate(spark, sf):
    out = {}

    def start(stream, checkpoint):
        out["path"] = checkpoint.rsplit("/", 1)[0] + "/updates"
        rates = jobs.sliding_rate(stream, ["event_type"], "ts", F.col("value") > 50, "7 days", "1 day", "1 day")
        jobs.run_available(rates, jobs.updates_job(out["path"]), checkpoint, "update")

    _arrivals(spark, _events(spark, sf), "win-rate", start)
    rows = jobs.current_rows(spark, out["path"], ["event_type", "start"])
    return rows.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "win_rate", "n")
