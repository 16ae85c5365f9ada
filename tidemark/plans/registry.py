"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DIGITS = 4
#: Moves decimal ties off the rounding boundary, so both engines round them alike.
NUDGE = 1e-8
Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Builder
    sql: str | Callable[[], str] | None
    doubles: tuple[str, ...]

    @property
    def oracle(self) -> str | None:
        """The SQL with every DOUBLE column rounded the way :func:`display` rounds it."""
        if self.sql is None:
            return None
        text = self.sql() if callable(self.sql) else self.sql
        if not self.doubles:
            return text
        rounded = ", ".join(f"round({c} + sign({c}) * {NUDGE}, {DIGITS}) + 0 AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({rounded}) FROM (\n{text}\n)"


REGISTRY: dict[str, Query] = {}


def display(df: DataFrame) -> DataFrame:
    """Operators return raw values; the registered queries round doubles and print dates."""
    cols = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = col.cast("double")
            col = F.round(value + F.signum(value) * NUDGE, DIGITS)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(col.alias(field.name))
    return df.select(*cols)


def query(name: str, ids: str, sql: str | Callable[[], str] | None = None, doubles: str = "") -> Callable[[Builder], Builder]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``doubles`` names the DOUBLE columns of the SQL."""

    def register(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(
            name, tuple(ids.split()), lambda spark, sf: display(fn(spark, sf)), sql, tuple(doubles.split())
        )
        return fn

    return register
