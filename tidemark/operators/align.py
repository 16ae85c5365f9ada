"""Calendar alignment, as-of joins and positional window columns over long panels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import dates
from tidemark.operators.scans import numbered, scanned, smaller_before

#: Indicator built from each series, whether it is a 12-row percent change, spine priority.
INDICATORS = {
    "INDPRO": ("indpro_yoy", True, 1),
    "UNRATE": ("unrate", False, 2),
    "RSAFS": ("retail_yoy", True, 3),
    "PAYEMS": ("payrolls_yoy", True, 4),
    "CPIAUCSL": ("cpi_yoy", True, 5),
    "CPILFESL": ("core_cpi_yoy", True, 6),
    "M2SL": ("m2_yoy", True, 7),
    "NFCI": ("nfci", False, 8),
    "WALCL": ("fed_assets_yoy", True, 9),
}
#: Release lag of each indicator in rows.
RELEASE_LAG = {
    "indpro_yoy": 2,
    "unrate": 1,
    "retail_yoy": 2,
    "payrolls_yoy": 1,
    "cpi_yoy": 1,
    "core_cpi_yoy": 1,
    "m2_yoy": 2,
    "nfci": 0,
    "fed_assets_yoy": 0,
}


def resample_last(
    obs: DataFrame,
    keys: Sequence[str] = ("entity_id", "series_id"),
    freq: str = "month",
    time: str = "obs_date",
    value: str = "value",
    bucket: str = "month",
) -> DataFrame:
    """Last non-null value per calendar month or per week ending on Friday; empty buckets are absent."""
    end = dates.month_end(F.col(time)) if freq == "month" else dates.week_friday(F.col(time))
    return (
        obs.where(F.col(value).isNotNull())
        .groupBy(*keys, end.alias(bucket))
        .agg(F.max_by(value, time).alias(value))
    )


def pct_change(col: Column, n: int, keys: Sequence[str], time: str) -> Column:
    """Positional fractional change against the value ``n`` rows earlier; null where that value is zero."""
    return F.try_divide(col, F.lag(col, n).over(Window.partitionBy(*keys).orderBy(time))) - 1


def diff(col: Column, n: int, keys: Sequence[str], time: str) -> Column:
    """Positional difference over ``n`` rows."""
    return col - F.lag(col, n).over(Window.partitionBy(*keys).orderBy(time))


def direction_signal(col: Column, keys: Sequence[str], time: str, n: int = 6, invert: bool = False) -> Column:
    """Sign of the ``n``-row difference: 1, 0 or -1; null where the difference is null."""
    sign = F.signum(diff(col, n, keys, time))
    return (-sign if invert else sign) + 0.0


def rolling_median(col: Column, keys: Sequence[str], time: str, rows: int = 36, min_rows: int = 12) -> Column:
    """Median of the last ``rows`` rows, null below ``min_rows`` non-null values."""
    frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(col).over(frame) >= min_rows, F.percentile(col, 0.5).over(frame))


def expanding_rank_pct(col: Column, keys: Sequence[str], time: str) -> Column:
    """(rank - 1) / (n - 1) of each value among the values up to it, ties counted as below; 0.5 for the first.

    Meant for calendar-grain keys: the history array of a row is as long as the number of months before it.
    """
    frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(col).over(frame)
    below = F.size(F.filter(seen, lambda z: z <= col))
    return F.when(
        col.isNotNull(), F.when(F.size(seen) > 1, (below - 1) / (F.size(seen) - 1)).otherwise(F.lit(0.5))
    )


def expanding_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, block: int = 4096) -> DataFrame:
    """``keys, order, value, out``: the rank of :func:`expanding_rank_pct` for keys of any length.

    ``order`` makes rows unique within a key; rows with a null value are left out. Rows are numbered by ``order`` and by (value,
    order), and both numbers cut a key into blocks of about four times the root of its rows, ``block`` at least. What lies at or
    below a row is then (a) whole pairs of blocks, earlier in time and lower in value, from prefix sums over the grid of block
    counts; (b) lower rows of its own time block; (c) lower rows of its own value block from earlier time blocks. No task holds
    more than one block, and the grid has a sixteenth of the rows at most.
    """
    keys, order = list(keys), list(order)
    known = df.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*keys)).alias("_key"), *keys, *order, value)
    both = numbered(numbered(known, ["_key"], order, "_t"), ["_key"], [value, "_t"], "_v")
    count = F.count("*")
    size = F.greatest(F.lit(block), F.ceil(4 * F.sqrt(count))).cast("bigint")
    sizes = both.groupBy("_key").agg(size.alias("_size"), F.ceil(count / size).cast("bigint").alias("_blocks"))
    cut = both.join(sizes, "_key").withColumns({"_tb": F.expr("(_t - 1) div _size"), "_vb": F.expr("(_v - 1) div _size")})

    def counting(by: str, what: str):
        """Add how many earlier rows, in the order of ``by``, have a smaller ``what``."""

        def run(rows: pa.Table) -> pa.Table:
            at = np.argsort(rows[by].to_numpy(), kind="stable")
            found = np.empty(len(at), np.int64)
            found[at] = smaller_before(rows[what].to_numpy()[at])
            below = rows["_below"].to_numpy() + found
            return rows.set_column(rows.column_names.index("_below"), "_below", pa.array(below))

        return run

    rows = cut.drop("_size", "_blocks").withColumn("_below", F.lit(0).cast("bigint"))
    schema = rows.schema
    timed = rows.groupBy("_key", "_tb").applyInArrow(counting("_t", "_v"), schema)
    valued = timed.groupBy("_key", "_vb").applyInArrow(counting("_v", "_tb"), schema)
    # Only keys of several blocks have a grid; every cell of it counts, empty ones too.
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)
    grid = sizes.where("_blocks > 1").select("_key", F.explode(blocks).alias("_tb"), "_blocks").select("_key", "_tb", F.explode(blocks).alias("_vb"))
    cells = cut.where("_blocks > 1").groupBy("_key", "_tb", "_vb").agg(F.count("*").alias("_c"))
    lower = Window.partitionBy("_key", "_tb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_key", "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    summed = grid.join(cells, ["_key", "_tb", "_vb"], "left").select("_key", "_tb", "_vb", F.sum("_c").over(lower).alias("_r"))
    whole = summed.select("_key", "_tb", "_vb", F.sum("_r").over(earlier).alias("_a"))
    below = F.col("_below") + F.coalesce("_a", F.lit(0))
    rank = F.when(F.col("_t") > 1, below / (F.col("_t") - 1)).otherwise(F.lit(0.5))
    return valued.join(whole, ["_key", "_tb", "_vb"], "left").select(*keys, *order, value, rank.alias(out))


def publication_lag(
    wide: DataFrame, keys: Sequence[str] = ("entity_id",), time: str = "month", lags: dict[str, int] | None = None
) -> DataFrame:
    """Shift each indicator column by its release lag in rows."""
    lags = RELEASE_LAG if lags is None else lags
    w = Window.partitionBy(*keys).orderBy(time)
    return wide.select(
        *[F.lag(c, lags[c]).over(w).alias(c) if lags.get(c, 0) > 0 else F.col(c) for c in wide.columns]
    )


def to_indicators(monthly: DataFrame) -> DataFrame:
    """Series values to indicators: 12-row percent change for levels, the value itself for rates."""
    table = F.create_map(*[F.lit(x) for s, (name, _, _) in INDICATORS.items() for x in (s, name)])
    levels = [s for s, (_, is_level, _) in INDICATORS.items() if is_level]
    change = pct_change(F.col("value"), 12, ("entity_id", "series_id"), "month") * 100
    return monthly.where(F.col("series_id").isin(list(INDICATORS))).select(
        "entity_id",
        "month",
        table[F.col("series_id")].alias("indicator"),
        F.when(F.col("series_id").isin(levels), change).otherwise(F.col("value")).alias("value"),
    )


def align_on_spine(indicators: DataFrame, require: str | None = "cpi_yoy") -> DataFrame:
    """One column per indicator on the months of the entity's first available indicator.

    Months where ``require`` is null are dropped afterwards, so later positional columns count surviving rows.
    """
    names = [name for name, _, _ in INDICATORS.values()]
    priority = F.create_map(*[F.lit(x) for name, _, p in INDICATORS.values() for x in (name, p)])[F.col("indicator")]
    first = F.min("_p").over(Window.partitionBy("entity_id"))
    wide = (
        indicators.select("*", priority.alias("_p"))
        .select("*", (F.col("_p") == first).alias("_spine"))
        .groupBy("entity_id", "month")
        .agg(
            F.max("_spine").alias("_spine"),
            *[F.max(F.when(F.col("indicator") == n, F.col("value"))).alias(n) for n in names],
        )
        .where("_spine")
        .drop("_spine")
    )
    return wide.where(F.col(require).isNotNull()) if require else wide


def _asof_union(left, right, keys, left_time, right_time, values):
    stamp = F.struct(F.col(right_time).alias("time"), *[F.col(v).alias(v) for v in values])
    missing = F.lit(None).cast(right.select(stamp.alias("s")).schema["s"].dataType)
    lhs = left.select(*keys, F.struct(*left.columns).alias("_left"), F.col(left_time).alias("_t"), missing.alias("_right"))
    rhs = right.select(
        *keys, F.lit(None).cast(lhs.schema["_left"].dataType).alias("_left"), F.col(right_time).alias("_t"), stamp.alias("_right")
    )
    both = lhs.unionByName(rhs)
    tag = F.col("_left").isNotNull().cast("int")
    return both.select("*", tag.alias("_tag"), F.unix_date(F.col("_t").cast("date")).alias("_day"))


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
) -> DataFrame:
    """Latest right row at or before each left row: adds ``matched_time`` and the right values.

    One union and one scan that cuts a key by row count; no range join.
    """
    both = _asof_union(left, right, keys, left_time, right_time, values)
    order = [F.col("_t"), F.col("_tag"), F.xxhash64("_left"), F.monotonically_increasing_id()]
    found = scanned(both, keys, order, {"_hit": ("last", F.col("_right"))}).where("_tag = 1")
    return found.select("_left.*", F.col("_hit.time").alias("matched_time"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    tolerance_days: int,
) -> DataFrame:
    """Nearest right row within an inclusive tolerance in days; an exact tie takes the later row.

    Both neighbours come from one scan: right rows of a day stand before its left rows, so the row behind is at most that day,
    and the one ahead is after it.
    """
    both = _asof_union(left, right, keys, left_time, right_time, values)
    order = [F.col("_day"), F.col("_tag"), F.xxhash64("_left"), F.monotonically_increasing_id()]
    found = scanned(both, keys, order, {"_past": ("last", F.col("_right")), "_next": ("next", F.col("_right"))}).where("_tag = 1")
    back = F.datediff(F.col("_t").cast("date"), F.col("_past.time").cast("date"))
    ahead = F.datediff(F.col("_next.time").cast("date"), F.col("_t").cast("date"))
    take_next = F.col("_next").isNotNull() & (F.col("_past").isNull() | (ahead <= back))
    hit = F.when(take_next, F.col("_next")).otherwise(F.col("_past"))
    gap = F.when(take_next, ahead).otherwise(back)
    kept = found.select("_left", F.when(gap <= tolerance_days, hit).alias("_hit"))
    return kept.select("_left.*", F.col("_hit.time").alias("matched_time"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def forward_return(
    prices: DataFrame,
    windows: Sequence[int],
    keys: Sequence[str] = ("asset_id",),
    time: str = "month",
    price: str = "close",
    execution_lag: int = 0,
    require_positive: bool = False,
) -> DataFrame:
    """Percent return over the next ``w`` rows, one row per window; starts ``execution_lag`` rows ahead."""
    w = Window.partitionBy(*keys).orderBy(time)
    start = F.lead(price, execution_lag).over(w) if execution_lag else F.col(price)
    rets = []
    for n in windows:
        ret = (F.try_divide(F.lead(price, n + execution_lag).over(w), start) - 1) * 100
        rets.append(F.struct(F.lit(n).alias("window"), (F.when(start > 0, ret) if require_positive else ret).alias("ret")))
    wide = prices.select(*keys, time, F.array(*rets).alias("_r"))
    return wide.select(*keys, time, F.inline("_r"))


def pair_spread(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Difference of two series on their common dates."""
    left = a.select(*keys, F.col(value).alias("a_value"))
    right = b.select(*keys, F.col(value).alias("b_value"))
    return left.join(right, keys).select("*", (F.col("a_value") - F.col("b_value")).alias("spread"))
