"""Forward returns conditioned on regimes: cells, benchmarks, stability, bootstrap and false-discovery control."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.functions.resample import BITS, bits_table

CELL = ("entity_id", "asset_id", "window")


def join_returns(regimes: DataFrame, fwd: DataFrame, keys: Sequence[str] = ("entity_id", "month")) -> DataFrame:
    """Regimes with the forward returns of the assets traded in their entity."""
    return regimes.join(fwd, list(keys))


def benchmarks(fwd: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Unconditional mean, sample deviation, standard error and count; fewer than two values give no row."""
    return (
        fwd.groupBy(*keys)
        .agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.count("ret").alias("n"))
        .where("n >= 2")
        .select(*keys, "mean", "std", (F.col("std") / F.sqrt("n")).alias("se"), "n")
    )


def cell_stats(
    joined: DataFrame, label: str, unconditional: DataFrame, keys: Sequence[str] = CELL, min_n: int = 10
) -> DataFrame:
    """Return distribution per (label, cell) with its excess over the unconditional mean."""
    stats = (
        joined.where(F.col(label).isNotNull())
        .groupBy(*keys, F.col(label).alias("label"))
        .agg(
            F.avg("ret").alias("mean"),
            F.stddev_samp("ret").alias("std"),
            F.percentile("ret", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
            (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("win_rate"),
            F.count("ret").alias("n"),
        )
        .where(F.col("n") >= min_n)
    )
    base = unconditional.select(*keys, F.col("mean").alias("unconditional_mean"))
    excess = F.col("mean") - F.col("unconditional_mean")
    se = F.col("std") / F.sqrt("n")
    return (
        stats.join(base, list(keys), "left")
        .select(
            *keys,
            "label",
            "mean",
            F.col("_q")[1].alias("median"),
            "std",
            "win_rate",
            F.col("_q")[0].alias("p25"),
            F.col("_q")[2].alias("p75"),
            "n",
            (F.col("n") < 20).alias("low_n"),
            "unconditional_mean",
            excess.alias("excess"),
            F.when(se > 0, excess / se).when(excess.isNotNull(), 0.0).alias("excess_vs_se"),
        )
        .select("*", (F.abs("excess_vs_se") > 1.0).alias("signal"))
    )


def grouped_cells(joined: DataFrame, keys: Sequence[str] = CELL, min_n: int = 10) -> DataFrame:
    """Cells by family, by eight labels and by family with liquidity side, in one grouping-sets aggregation."""
    data = joined.select(*keys, "month", "regime", "regime_8", "liquidity_binary", "ret")
    k = [F.col(c) for c in keys]
    sets = [
        [*k, F.col("regime")],
        [*k, F.col("regime_8")],
        [*k, F.col("regime"), F.col("liquidity_binary")],
    ]
    grouped = data.groupingSets(sets, *k, F.col("regime"), F.col("regime_8"), F.col("liquidity_binary")).agg(
        F.count("*").alias("n_months"),
        F.count("ret").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("std"),
        F.grouping("regime").alias("_no4"),
        F.grouping("liquidity_binary").alias("_noliq"),
    )
    layer = F.when(F.col("_no4") == 1, "eight").when(F.col("_noliq") == 1, "family").otherwise("family_liquidity")
    label = (
        F.when(F.col("_no4") == 1, F.col("regime_8"))
        .when(F.col("_noliq") == 1, F.col("regime"))
        .otherwise(F.concat("regime", F.lit(" + "), "liquidity_binary", F.lit(" liquidity")))
    )
    enough = F.col("n") >= min_n
    return grouped.select(
        *keys,
        layer.alias("layer"),
        label.alias("label"),
        "n_months",
        "n",
        F.when(enough, F.col("mean")).alias("mean"),
        F.when(enough, F.col("std")).alias("std"),
        (F.col("n_months") < min_n).alias("insufficient"),
    ).where(F.col("label").isNotNull())


def power(joined: DataFrame, label: str, keys: Sequence[str] = CELL, min_n: int = 5) -> DataFrame:
    """Minimum detectable effect of each cell: 2.8 standard errors."""
    return (
        joined.groupBy(*keys, F.col(label).alias("label"))
        .agg(F.stddev_samp("ret").alias("std"), F.count("ret").alias("n"))
        .where(F.col("n") >= min_n)
        .select(*keys, "label", (F.col("std") / F.sqrt("n") * 2.8).alias("mde"), "n", "std")
    )


def stability(joined: DataFrame, split: str, keys: Sequence[str] = CELL, min_n: int = 10, min_months: int = 20) -> DataFrame:
    """Cell means before and after a date: difference, same sign, stable; entities with a short half give no row.

    Both halves are conditional aggregates of one pass, so no self join is needed.
    """
    early = F.col("month") <= F.lit(split).cast("date")
    value = F.col("ret")
    months = joined.groupBy("entity_id", "month").agg(F.first(early).alias("_early")).groupBy("entity_id").agg(
        F.sum(F.col("_early").cast("int")).alias("train_months"),
        F.sum((~F.col("_early")).cast("int")).alias("test_months"),
    )
    cells = (
        joined.groupBy(*keys, F.col("regime").alias("label"))
        .agg(
            F.count(F.when(early, value)).alias("n_in"),
            F.count(F.when(~early, value)).alias("n_out"),
            F.avg(F.when(early, value)).alias("_in"),
            F.avg(F.when(~early, value)).alias("_out"),
            F.stddev_samp(F.when(early, value)).alias("_std"),
        )
        .where((F.col("n_in") >= min_n) | (F.col("n_out") >= min_n))
    )
    both = (F.col("n_in") >= min_n) & (F.col("n_out") >= min_n)
    a, z = F.col("_in"), F.col("_out")
    same = ((a > 0) & (z > 0)) | ((a < 0) & (z < 0)) | (a == 0) | (z == 0)
    enough = months.where((F.col("train_months") >= min_months) & (F.col("test_months") >= min_months))
    return cells.join(enough.select("entity_id"), "entity_id", "left_semi").select(
        *keys,
        "label",
        F.when(both, "compared").otherwise("missing_in_half").alias("status"),
        F.when(both, a).alias("in_mean"),
        F.when(both, z).alias("out_mean"),
        F.when(both, z - a).alias("diff"),
        F.when(both, same).otherwise(False).alias("same_sign"),
        F.when(both, same & (F.abs(z - a) < F.col("_std"))).otherwise(False).alias("stable"),
    )


def liquidity_value(joined: DataFrame, window: int = 3, keys: Sequence[str] = CELL, min_n: int = 10) -> DataFrame:
    """Spread of loose and tight means within a family, against the family's own deviation."""
    loose, tight = F.col("liquidity_binary") == "loose", F.col("liquidity_binary") == "tight"
    cells = (
        joined.where(F.col("window") == window)
        .groupBy(*keys, F.col("regime").alias("label"))
        .agg(
            F.avg("ret").alias("base_mean"),
            F.stddev_samp("ret").alias("base_std"),
            F.avg(F.when(loose, F.col("ret"))).alias("loose_mean"),
            F.avg(F.when(tight, F.col("ret"))).alias("tight_mean"),
            F.count("ret").alias("_n"),
            F.count(F.when(loose, F.col("ret"))).alias("_nl"),
            F.count(F.when(tight, F.col("ret"))).alias("_nt"),
        )
        .where((F.col("_n") >= min_n) & (F.col("_nl") >= min_n) & (F.col("_nt") >= min_n))
    )
    spread = F.abs(F.col("loose_mean") - F.col("tight_mean"))
    return cells.select(
        *keys,
        "label",
        "base_mean",
        "loose_mean",
        "tight_mean",
        spread.alias("spread"),
        "base_std",
        F.when(F.col("base_std") > 0, spread / F.col("base_std")).otherwise(0.0).alias("information_ratio"),
        (spread > F.col("base_std") * 0.5).alias("matters"),
    )


def transition_returns(regimes: DataFrame, fwd: DataFrame, window: int = 3) -> DataFrame:
    """Number of changes per (from, to) and the mean return after them; the first row of an entity is no change."""
    w = Window.partitionBy("entity_id").orderBy("month")
    changes = (
        regimes.select("entity_id", "month", "regime", F.lag("regime").over(w).alias("prior"))
        .where(F.col("prior").isNotNull() & (F.col("prior") != F.col("regime")))
        .select("entity_id", "month", "prior", "regime")
    )
    rets = fwd.where(F.col("window") == window)
    return (
        changes.join(rets, ["entity_id", "month"])
        .groupBy("entity_id", "prior", "regime", "asset_id")
        .agg(F.count("*").alias("n_transitions"), F.avg("ret").alias("_m"), F.count("ret").alias("n"))
        .select("entity_id", "prior", "regime", "asset_id", "n_transitions", F.when(F.col("n") >= 2, F.col("_m")).alias("mean"), "n")
    )


def resampled_means(values: np.ndarray, block: int, replicates: int, seed: int) -> np.ndarray:
    """Means of moving-block resamples, each a sum of differences of prefix sums."""
    n = len(values)
    sums = np.append(0.0, np.cumsum(values))
    lengths = np.minimum(block, n - np.arange(0, n, block))
    # The table is made for a power of two of blocks, so that cells of different lengths share it.
    columns = 1 << (len(lengths) - 1).bit_length()
    start = (bits_table(seed, replicates, columns)[:, : len(lengths)] * max(1, n - block + 1)) >> BITS
    return (sums[start + lengths] - sums[start]).sum(1) / n


def bootstrap_mean(
    joined: DataFrame,
    label: str,
    unconditional: DataFrame,
    keys: Sequence[str] = CELL,
    replicates: int = 1000,
    ci: float = 0.90,
    seed: int = 42,
    min_n: int = 15,
) -> DataFrame:
    """Moving-block bootstrap of each cell mean; the block is the forward window.

    Values of a cell are ordered by month (a cell holds at most one value per month) and stay in its row with their prefix sums:
    nothing is exploded or shuffled per replicate. Draws come from digests, so results do not depend on partitioning.
    """
    group = [*keys, "label"]
    cells = (
        joined.where(F.col("ret").isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(label).alias("label"))
        .agg(
            F.array_sort(F.collect_list(F.struct("month", "ret"))).alias("_s"),
            F.count("*").alias("n"),
            F.avg("ret").alias("mean"),
            F.stddev_pop("ret").alias("_std"),
        )
        .where((F.col("n") >= min_n) & (F.col("_std") >= 1e-6))
        .join(unconditional.select(*keys, F.col("mean").alias("unconditional_mean")), list(keys))
    )
    rows = cells.select(*group, "n", "mean", "unconditional_mean", F.col("window").cast("int").alias("_block"), F.transform("_s", lambda x: x["ret"]).alias("_v"))
    tail = 100 * (1 - ci) / 2
    found = ["ci_low", "ci_high", "p_value"]

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, block, mean, u in zip(*[batch.column(c) for c in ("_v", "_block", "mean", "unconditional_mean")], strict=True):
                means = resampled_means(v.values.to_numpy(), block.as_py(), replicates, seed)
                low, high = np.percentile(means, [tail, 100 - tail])
                side = means <= u.as_py() if mean.as_py() >= u.as_py() else means >= u.as_py()
                out.append((low, high, min(1.0, 2 * side.mean())))
            kept = batch.drop_columns(["_block", "_v"])
            results = np.array(out, np.float64).reshape(-1, 3)
            yield pa.record_batch([*kept.columns, *[pa.array(results[:, i]) for i in range(3)]], names=[*kept.schema.names, *found])

    schema = T.StructType([f for f in rows.schema if f.name not in ("_block", "_v")] + [T.StructField(c, T.DoubleType()) for c in found])
    u = F.col("unconditional_mean")
    return rows.mapInArrow(resample, schema).select("*", ((u < F.col("ci_low")) | (u > F.col("ci_high"))).alias("significant"))


def benjamini_hochberg(
    df: DataFrame, p: str, family_keys: Sequence[str], alpha: float = 0.10, tie: Sequence[str] = ()
) -> DataFrame:
    """Step-up false-discovery control within each family of tests: adds ``bh_significant``."""
    w = Window.partitionBy(*family_keys)
    ranked = df.select(
        "*",
        F.row_number().over(w.orderBy(p, *tie)).alias("_rank"),
        F.count("*").over(w).alias("_m"),
    )
    passed = F.when(F.col(p) <= F.col("_rank") / F.col("_m") * alpha, F.col("_rank"))
    return (
        ranked.select("*", F.max(passed).over(w).alias("_k"))
        .select("*", F.coalesce(F.col("_rank") <= F.col("_k"), F.lit(False)).alias("bh_significant"))
        .drop("_rank", "_m", "_k")
    )


def significance_summary(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tested and passed cells; underpowered when fewer than a quarter pass."""
    share = F.avg(F.col("bh_significant").cast("double")) * 100
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("n_tested"),
        F.sum(F.col("bh_significant").cast("bigint")).alias("n_significant"),
        share.alias("pct_significant"),
        (share < 25).alias("underpowered"),
    )

