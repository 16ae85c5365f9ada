"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

#: Settings the operators are tuned for. A cluster keeps its own values for memory and shuffle width.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: For :func:`materialise`: what was shuffled for a write goes when it is done, and not when the driver happens to collect its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: Scratch folders of local sessions that name none, by application.
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which every executor must reach.

    Without that setting only a local session, whose executor is the driver itself, gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL_ROOTS.setdefault(context.applicationId, os.path.join(os.getcwd(), "spark-warehouse", f"scratch-{context.applicationId}"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Run with other values of the session's settings; the ones before hold again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(
    df: DataFrame, label: str, conf: dict[str, str] | None = None, options: dict[str, str] | None = None, slices: Sequence[Column] = ()
) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage that outlives executors.

    ``conf`` are settings that hold while it is written, ``options`` those of the Parquet writer. ``slices`` are conditions of which
    each row meets one: rows are then written slice by slice, and with :data:`FREED` only one slice's shuffles lie on disk.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, conf or {}):
        for part in [df.where(c) for c in slices] or [df]:
            part.write.mode("append").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
