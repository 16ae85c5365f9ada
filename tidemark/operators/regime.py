"""Scores, labels and confirmation of regimes, for many entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import labels
from tidemark.operators import align

KEYS = ("entity_id",)
#: Growth votes (indicator, inverted) and liquidity votes (indicator, lower is looser).
GROWTH = (("indpro_yoy", False), ("unrate", True), ("retail_yoy", False), ("payrolls_yoy", False))
LIQUIDITY = (("m2_yoy", False), ("nfci", True), ("fed_assets_yoy", False))
DIRECTION_ROWS = 6


def growth_votes(n: int = DIRECTION_ROWS) -> list[Column]:
    """One direction vote per growth indicator."""
    return [align.direction_signal(F.col(c), KEYS, "month", n, inv).alias(f"vote_{c}") for c, inv in GROWTH]


def growth_score(n: int = DIRECTION_ROWS) -> Column:
    """Mean of the available direction votes."""
    return labels.mean_of([align.direction_signal(F.col(c), KEYS, "month", n, inv) for c, inv in GROWTH])


def inflation_score(n: int = DIRECTION_ROWS) -> Column:
    """Mean change of headline and core, missing changes read as zero; headline alone where an entity has no core."""
    cpi = F.coalesce(align.diff(F.col("cpi_yoy"), n, KEYS, "month"), F.lit(0.0))
    core = F.coalesce(align.diff(F.col("core_cpi_yoy"), n, KEYS, "month"), F.lit(0.0))
    has_core = F.max(F.col("core_cpi_yoy").isNotNull()).over(Window.partitionBy(*KEYS))
    return F.when(has_core, (cpi + core) / 2).otherwise(cpi)


def liquidity_vote(c: str, inverted: bool, rows: int = 36, min_rows: int = 12) -> Column:
    """1 on the loose side of the rolling median, else 0; null while the median is undefined."""
    median = align.rolling_median(F.col(c), KEYS, "month", rows, min_rows)
    loose = F.col(c) < median if inverted else F.col(c) > median
    return F.when(median.isNotNull(), F.coalesce(loose, F.lit(False)).cast("double"))


def liquidity_score(rows: int = 36, min_rows: int = 12) -> Column:
    """Share of available indicators on the loose side of their rolling median."""
    return labels.mean_of([liquidity_vote(c, inv, rows, min_rows) for c, inv in LIQUIDITY])


def confirmation_filter(
    df: DataFrame,
    keys: list[str],
    time: str,
    label: str,
    out: str,
    k: int = 2,
    initial: Column | str | None = None,
) -> DataFrame:
    """Adopt a label once it is seen ``k`` times in a row; the first label is adopted at once.

    An exact fold over the label sequence of each key, nulls included. Sequences are at calendar grain, so the array
    of a key is bounded by the number of periods. Rows travel inside that array, so the input is computed only once.
    """
    seed = initial if isinstance(initial, Column) else F.lit(initial).cast("string")
    rest = [c for c in df.columns if c not in (*keys, time)]
    rows = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(time, *rest))).alias("_seq"), F.first(seed).alias("_seed")
    )
    null = F.lit(None).cast("string")
    start = F.struct(
        F.col("_seed").alias("now"), null.alias("pending"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("done")
    )

    def step(acc: Column, raw: Column) -> Column:
        now, pending, n = acc["now"], acc["pending"], acc["n"]
        fresh, same, repeat = now.isNull(), raw.eqNullSafe(now), raw.eqNullSafe(pending)
        adopt = ~fresh & ~same & repeat & (n + 1 >= k)
        settled = fresh | same | adopt
        new_now = F.when(fresh | adopt, raw).otherwise(now)
        return F.struct(
            new_now.alias("now"),
            F.when(settled, null).otherwise(raw).alias("pending"),
            F.when(settled, F.lit(0)).when(repeat, n + 1).otherwise(F.lit(1)).alias("n"),
            F.concat(acc["done"], F.array(new_now)).alias("done"),
        )

    folded = F.aggregate(F.transform("_seq", lambda r: r[label]), start, step, lambda acc: acc["done"])
    zipped = rows.select(*keys, F.explode(F.arrays_zip(F.col("_seq").alias("row"), folded.alias("label"))).alias("_x"))
    return zipped.select(
        *keys, *[F.col("_x.row")[c].alias(c) for c in (time, *rest)], F.col("_x.label").alias(out)
    ).select(*df.columns, out)


def confirmation_anchors(label: Column, keys: list[str], time: str) -> Column:
    """Window form of the two-sighting filter for labels that are null only before the first one."""
    w = Window.partitionBy(*keys).orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.count(label).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 0
    anchor = F.when(first | (label == F.lag(label).over(w)), label)
    return F.last(anchor, ignorenulls=True).over(so_far)


def aligned(obs: DataFrame) -> DataFrame:
    """Observations to the aligned wide monthly table.

    Raw rows are reduced to months where they lie. Then entities are brought together once; every later grouping and window
    contains the entity and reuses that placement.
    """
    return align.align_on_spine(align.to_indicators(align.resample_last(obs).repartition("entity_id")))


def scored(wide: DataFrame) -> DataFrame:
    """Aligned table plus the three scores and the axis directions."""
    return wide.select(
        "*",
        growth_score().alias("growth_score"),
        inflation_score().alias("inflation_score"),
        liquidity_score().alias("liquidity_score"),
    ).select(
        "*",
        labels.axis_direction(F.col("growth_score")).alias("growth_direction"),
        labels.axis_direction(F.col("inflation_score")).alias("inflation_direction"),
    )


def classify(obs: DataFrame, k: int = 2) -> DataFrame:
    """Observations to confirmed regimes, one row per (entity, month)."""
    raw = scored(aligned(obs)).select(
        "*", labels.family(F.col("growth_direction"), F.col("inflation_direction")).alias("regime_raw")
    )
    done = confirmation_filter(raw, list(KEYS), "month", "regime_raw", "regime", k)
    return (
        done.where(F.col("regime").isNotNull())
        .select(
            "*",
            labels.liquidity_binary(F.col("liquidity_score")).alias("liquidity_binary"),
            labels.liquidity_level(F.col("liquidity_score")).alias("liquidity_condition"),
        )
        .select("*", labels.label8(F.col("regime"), F.col("liquidity_binary")).alias("regime_8"))
    )


def min_history(obs: DataFrame, n_series: int = 3, n_months: int = 7) -> DataFrame:
    """Per entity: number of series and months, and whether they suffice for a classification."""
    return (
        obs.groupBy("entity_id", "series_id", F.last_day("obs_date").alias("month"))
        .agg(F.count("value").alias("n"))
        .groupBy("entity_id", "month")
        .agg(F.collect_set("series_id").alias("ids"))
        .groupBy("entity_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("bigint").alias("n_series"),
            F.count("*").alias("n_months"),
        )
        .select("*", ((F.col("n_series") >= n_series) & (F.col("n_months") >= n_months)).alias("enough"))
    )


def latest(regimes: DataFrame) -> DataFrame:
    """Last month per entity with raw and confirmed labels side by side."""
    cols = [c for c in regimes.columns if c != "entity_id"]
    last = regimes.groupBy("entity_id").agg(F.max_by(F.struct(*cols), "month").alias("r"))
    return last.select("entity_id", "r.*").select("*", F.col("regime_raw").eqNullSafe(F.col("regime")).alias("agrees"))


def signal_detail(wide: DataFrame) -> DataFrame:
    """Last row per (entity, indicator): vote, current value, value six rows ago, direction word, median and side."""
    w = Window.partitionBy("entity_id").orderBy("month")
    parts = []
    for c, inv in GROWTH:
        vote = align.direction_signal(F.col(c), KEYS, "month", DIRECTION_ROWS, inv)
        up, down = ("falling_good", "rising_bad") if inv else ("rising", "falling")
        parts.append(
            F.struct(
                F.lit("growth").alias("axis"),
                F.lit(c).alias("indicator"),
                vote.alias("vote"),
                F.col(c).alias("current"),
                F.lag(c, DIRECTION_ROWS).over(w).alias("earlier"),
                F.when(vote > 0, up).when(vote < 0, down).otherwise("flat").alias("word"),
                F.lit(None).cast("double").alias("median"),
            )
        )
    for c, inv in LIQUIDITY:
        vote = liquidity_vote(c, inv)
        yes, no = ("below_loose", "above_tight") if inv else ("above", "below")
        parts.append(
            F.struct(
                F.lit("liquidity").alias("axis"),
                F.lit(c).alias("indicator"),
                vote.alias("vote"),
                F.col(c).alias("current"),
                F.lit(None).cast("double").alias("earlier"),
                F.when(vote == 1, yes).when(vote == 0, no).otherwise("unknown").alias("word"),
                align.rolling_median(F.col(c), KEYS, "month").alias("median"),
            )
        )
    detailed = wide.select("entity_id", "month", F.array(*parts).alias("_d"))
    last = detailed.groupBy("entity_id").agg(F.max("month").alias("month"), F.max_by("_d", "month").alias("_d"))
    return last.select("entity_id", "month", F.inline("_d"))
