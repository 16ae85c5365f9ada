"""Writers: dated copies, keyed upserts, append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_dated(df: DataFrame, path: str, run_date: str) -> None:
    """Write one partition per run date; a rerun of a date replaces only that date."""
    (
        df.withColumn("run_date", F.lit(run_date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest run date; the subquery prunes to a single partition."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("run_date").alias("run_date"))
    return table.join(F.broadcast(newest), "run_date")


def upsert_history(hist: DataFrame, new: DataFrame, keys: Sequence[str], fill: dict[str, str] | None = None) -> DataFrame:
    """New values replace those of the same key field by field, other rows stay; ``fill`` applies only where absent."""
    keys = list(keys)
    cols = [c for c in dict.fromkeys([*hist.columns, *new.columns]) if c not in keys]
    a = hist.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in hist.columns if c not in keys])
    z = new.select(*keys, *[F.col(c).alias(f"_z_{c}") for c in new.columns if c not in keys])
    both = a.join(z, keys, "full_outer")
    fill = fill or {}

    def merged(c: str):
        parts = [F.col(p) for p in (f"_z_{c}", f"_a_{c}") if p in both.columns]
        return F.coalesce(*parts, *([F.lit(fill[c])] if c in fill else [])).alias(c)

    extra = [F.lit(v).alias(c) for c, v in fill.items() if c not in cols]
    return both.select(*keys, *[merged(c) for c in cols], *extra)


def append_run_log(df: DataFrame, path: str) -> None:
    """Append entries to a JSON-lines log."""
    df.write.mode("append").json(path)
