"""Structured Streaming twins of the stateful operators.

Scans that must follow event order and sessions keep their state in Spark's state store, see
:mod:`tidemark.streaming.state`; windowed aggregates use watermarks. What corrects earlier rows is a log of updates, one folder
per micro-batch, which a replayed batch writes again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Batch = Callable[[DataFrame, int], None]


def run_available(stream: DataFrame, handle: Batch, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished rows to a Parquet table, exactly once."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def version(root: str, batch_id: int) -> str:
    return f"{root}/v={batch_id}"


def newest(log: DataFrame, before: float = float("inf")) -> dict[int, int]:
    """The newest version below ``before`` of every bucket of a keyed table, from the listing of its files."""
    found: dict[int, int] = {}
    for path in log.inputFiles():
        parts = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
        bucket, v = int(parts["_bucket"]), int(parts["v"])
        if v < before:
            found[bucket] = max(found.get(bucket, -1), v)
    return found


def keyed_table(spark: SparkSession, root: str) -> DataFrame:
    """Current rows of a keyed table written by :func:`upsert_job`."""
    log = spark.read.parquet(root)
    folders = [f"{version(root, v)}/_bucket={b}" for b, v in newest(log).items()]
    return spark.read.schema(log.drop("_bucket", "v").schema).parquet(*folders)


def upsert_job(root: str, keys: list[str], at: list[str], buckets: int = 64) -> Batch:
    """Keyed table where the last write of a key wins.

    Keys are dealt into buckets. A batch writes a new version of the buckets that it touches and reads only their versions
    before it, so what is written follows the batch; a replayed batch writes the same version again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows = batch
        if batch_id > 0:
            latest = newest(spark.read.schema(batch.schema).parquet(root), batch_id)
            touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]
            folders = [f"{version(root, latest[b])}/_bucket={b}" for b in touched if b in latest]
            if folders:
                before = spark.read.schema(batch.schema).option("basePath", root).parquet(*folders)
                rows = batch.unionByName(before.select(*batch.columns))
        rest = [c for c in batch.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r")).select(*keys, "_r.*")
        best.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(version(root, batch_id))

    return handle


def updates_job(out: str) -> Batch:
    """Log of window updates; the newest batch of a key holds its current value."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(version(out, batch_id))

    return handle


def current_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current value of every window, row or session in an update log."""
    log = spark.read.parquet(out)
    rest = [c for c in log.columns if c not in (*keys, "v")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "v").alias("_r")).select(*keys, "_r.*")


def bucket_last(stream: DataFrame, keys: list[str], ts: str, value: str, tie: str, length: str, offset: str, delay: str) -> DataFrame:
    """Last value per tumbling bucket, late rows accepted within the watermark."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, startTime=offset), *keys)
        .agg(F.max_by(value, F.struct(ts, tie)).alias(value), F.count("*").alias("n"))
        .select(*keys, F.col("window.start").alias("start"), value, "n")
    )


def sliding_rate(stream: DataFrame, keys: list[str], ts: str, won: Column, length: str, slide: str, delay: str) -> DataFrame:
    """Win rate per sliding time window."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, slide), *keys)
        .agg((F.avg(won.cast("double")) * 100).alias("win_rate"), F.count("*").alias("n"))
        .select(*keys, F.col("window.start").alias("start"), "win_rate", "n")
    )


def confirmation_stream(stream: DataFrame, key: str, time: str, label: str, k: int = 2) -> DataFrame:
    """Confirmation filter whose confirmed label, pending label and count live in keyed state between batches.

    Labels arrive at calendar grain, so the rows of a key in one batch are few.
    """

    def advance(keys: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        now, pending, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(time)
        confirmed = []
        for raw in rows[label]:
            adopt = now is None or (raw == pending and raw != now and n + 1 >= k)
            if adopt or raw == now:
                now, pending, n = (raw if adopt else now), None, 0
            else:
                pending, n = raw, (n + 1 if raw == pending else 1)
            confirmed.append(now)
        state.update((now, pending, n))
        yield pd.DataFrame({key: keys[0], time: rows[time], label: rows[label], "confirmed": confirmed})

    return stream.groupBy(key).applyInPandasWithState(
        advance,
        f"{key} STRING, {time} DATE, {label} STRING, confirmed STRING",
        "now STRING, pending STRING, n INT",
        "append",
        GroupStateTimeout.NoTimeout,
    )
