"""Regime runs, transition matrices, durations and frequencies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import labels as L

HORIZONS = (6, 12)
LOW_N = 10
SHRINKAGE_WEIGHT = 10.0


def runs(df: DataFrame, keys: Sequence[str], time: str, label: str) -> DataFrame:
    """Gaps and islands: one row per run of equal labels with start, end, length and whether it is the current one."""
    w = Window.partitionBy(*keys).orderBy(time)
    changed = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    islands = df.where(F.col(label).isNotNull()).select(*keys, time, label, changed.alias("_c"))
    numbered = islands.select("*", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    per_run = numbered.groupBy(*keys, "run", label).agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("length")
    )
    latest = F.max("run").over(Window.partitionBy(*keys))
    return per_run.select("*", (F.col("run") == latest).alias("is_current"))


def timeline(df: DataFrame, keys: Sequence[str], time: str, label: str) -> DataFrame:
    """Periods whose end is the start of the next one; the last period ends on its own last row."""
    w = Window.partitionBy(*keys).orderBy("start")
    return runs(df, keys, time, label).select(
        *keys, label, "start", F.coalesce(F.lead("start").over(w), F.col("end")).alias("end")
    )


def duration_stats(df: DataFrame, keys: Sequence[str], time: str, label: str) -> DataFrame:
    """Mean, median (truncated) and longest run per label, number of episodes, length of the current run."""
    return (
        runs(df, keys, time, label)
        .groupBy(*keys, label)
        .agg(
            F.avg("length").alias("mean_months"),
            F.percentile("length", 0.5).cast("bigint").alias("median_months"),
            F.max("length").alias("max_months"),
            F.count("*").alias("n_episodes"),
            F.max(F.when(F.col("is_current"), F.col("length"))).cast("double").alias("current_months"),
        )
    )


def frequency(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Count and percentage of each label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) * 100).alias("pct"))


def transition_counts(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    label: str,
    all_labels: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """Counts and probabilities of (label now, label ``h`` rows ahead) over every pair of labels.

    Unseen pairs come from a literal grid added to one row of each key, so the whole matrix costs one window and one
    aggregation. Probabilities of an unseen source are null.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    seen = df.where(F.col(label).isNotNull())

    def cell(h: Column, source: Column, target: Column, n: Column) -> Column:
        return F.struct(h.alias("horizon"), source.alias("source"), target.alias("target"), n.alias("n"))

    pairs = F.array(*[cell(F.lit(h), F.col(label), F.lead(label, h).over(w), F.lit(1)) for h in horizons])
    grid = F.array(
        *[cell(F.lit(h), F.lit(s), F.lit(t), F.lit(0)) for h in horizons for s in all_labels for t in all_labels]
    )
    rows = seen.select(
        *keys, pairs.alias("_p"), F.row_number().over(w).alias("_rn")
    ).select(*keys, F.inline(F.when(F.col("_rn") == 1, F.concat("_p", grid)).otherwise(F.col("_p"))))
    counted = (
        rows.where(F.col("target").isNotNull() & F.col("source").isin(list(all_labels)) & F.col("target").isin(list(all_labels)))
        .groupBy(*keys, "horizon", "source", "target")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*keys, "horizon", "source"))
    return counted.select("*", total.alias("n_source")).select(
        "*",
        F.when(F.col("n_source") > 0, F.col("n") / F.col("n_source")).alias("prob"),
        (F.col("n_source") < LOW_N).alias("low_n"),
    )


def shrink(eight: DataFrame, four: DataFrame, keys: Sequence[str], weight: float = SHRINKAGE_WEIGHT, variants: int = 2) -> DataFrame:
    """Pull 8-label probabilities toward the 4-label ones, split over a family's variants, and renormalise."""
    prior = four.select(
        *keys, "horizon", F.col("source").alias("source_4"), F.col("target").alias("target_4"), F.col("prob").alias("prior")
    )
    joined = eight.select(
        "*", L.family_of(F.col("source")).alias("source_4"), L.family_of(F.col("target")).alias("target_4")
    ).join(prior, [*keys, "horizon", "source_4", "target_4"], "left")
    alpha = F.col("n_source") / (F.col("n_source") + F.lit(weight))
    blended = F.when(F.col("prior").isNull(), F.col("prob")).otherwise(
        alpha * F.col("prob") + (1 - alpha) * F.col("prior") / variants
    )
    mixed = joined.select(*keys, "horizon", "source", "target", "n", "n_source", "prob", blended.alias("_m"))
    total = F.sum("_m").over(Window.partitionBy(*keys, "horizon", "source"))
    return mixed.select("*", F.when(total > 0, F.col("_m") / total).otherwise(F.col("_m")).alias("shrunk")).drop("_m")


def sample_windows(
    df: DataFrame, keys: Sequence[str], time: str, since: str, label8: str = "regime_8", min_rows: int = 12
) -> DataFrame:
    """Repeat rows for the full sample and for the rows since a date; short windows are left out.

    ``valid_8`` tells whether any label of the window carries its liquidity side.
    """
    names = F.array_compact(F.array(F.lit("full"), F.when(F.col(time) >= F.lit(since).cast("date"), F.lit("recent"))))
    spread = df.select("*", F.explode(names).alias("sample"))
    per = Window.partitionBy(*keys, "sample")
    valid = F.coalesce(F.max(L.has_liquidity_suffix(F.col(label8))).over(per), F.lit(False))
    marked = spread.select("*", F.count("*").over(per).alias("_rows"), valid.alias("valid_8"))
    return marked.where(F.col("_rows") >= min_rows).drop("_rows")


def by_label_set(sampled: DataFrame, statistic: Callable[[DataFrame, str], DataFrame], label4: str = "regime", label8: str = "regime_8") -> DataFrame:
    """``statistic(rows, label)`` over the four-part labels of every sample, and over the eight-part ones of valid samples."""
    four = statistic(sampled, label4).withColumnRenamed(label4, "label").withColumn("label_set", F.lit(4))
    eight = statistic(sampled.where("valid_8"), label8).withColumnRenamed(label8, "label").withColumn("label_set", F.lit(8))
    return four.unionByName(eight)


def dedupe_latest(hist: DataFrame, keys: Sequence[str], ingest: str) -> DataFrame:
    """Last write per key."""
    rest = [c for c in hist.columns if c not in keys]
    return hist.groupBy(*keys).agg(F.max_by(F.struct(*rest), ingest).alias("_r")).select(*keys, "_r.*")


def trailing_streak(hist: DataFrame, keys: Sequence[str], time: str, predicates: dict[str, Column]) -> DataFrame:
    """Length of the last unbroken stretch of rows where each predicate holds (null counts as false).

    A streak is the number of rows after the latest row that breaks it; both are plain aggregates over a
    calendar-grain table, so no window is needed.
    """
    marks = hist.select(*keys, time, *[F.coalesce(p, F.lit(False)).alias(f"_{n}") for n, p in predicates.items()])
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    placed = marks.select("*", F.row_number().over(w).alias("_pos"))
    aggs = [
        (F.coalesce(F.min(F.when(~F.col(f"_{n}"), F.col("_pos"))), F.count("*") + 1) - 1).cast("bigint").alias(n)
        for n in predicates
    ]
    return placed.groupBy(*keys).agg(*aggs)
