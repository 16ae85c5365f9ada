"""Ordered scans that survive hot keys.

A window over ``partitionBy(key).orderBy(time)`` puts a whole key into one task. Where a key may hold an unbounded
number of rows (events of one account, orders of one symbol) these helpers cut it into time buckets: totals per
(key, bucket) are aggregated map-side first, carried across the few buckets of a key, and the row-level window runs
per (key, bucket). Where even a time bucket may be unbounded, :func:`scanned` cuts by row count,
and only keys that need it. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.session import FREED, materialise

KINDS = ("sum", "count", "max", "first", "prev", "last")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    specs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add running columns up to and including each row.

    The rows are read twice, once for the totals and once for the scan; use :func:`scanned` where they come out of joins or
    earlier scans, which would otherwise run again.

    ``specs`` maps an output name to (kind, column): ``sum``, ``count``, ``max`` accumulate; ``first`` is the first
    value of the key; ``prev`` the value one row earlier; ``last`` the latest non-null value so far.
    ``order`` must make rows unique within a key and grow with ``bucket``.
    """
    order_names = [f"_o{i}" for i in range(len(order))]
    work = df.select(
        "*",
        bucket.alias("_b"),
        *[c.alias(n) for c, n in zip(order, order_names)],
        *[c.alias(f"_v_{n}") for n, (_, c) in specs.items()],
    )
    position = F.struct(*order_names)
    totals = []
    for name, (kind, _) in specs.items():
        value = F.col(f"_v_{name}")
        if kind == "sum":
            total = F.sum(value)
        elif kind == "count":
            total = F.count(value)
        elif kind == "max":
            total = F.max(value)
        elif kind == "first":
            total = F.min_by(F.struct(value.alias("v")), position)
        elif kind == "prev":
            total = F.max_by(F.struct(value.alias("v")), position)
        elif kind == "last":
            total = F.max_by(value, F.when(value.isNotNull(), position))
        else:
            raise ValueError(f"unknown kind {kind!r}; use one of {KINDS}")
        totals.append(total.alias(f"_t_{name}"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for name, (kind, _) in specs.items():
        total = F.col(f"_t_{name}")
        if kind in ("sum", "count"):
            expr = F.coalesce(F.sum(total).over(before), F.lit(0))
        elif kind == "max":
            expr = F.max(total).over(before)
        elif kind == "first":
            expr = F.first(total).over(before)
        elif kind == "prev":
            expr = F.last(total).over(before)
        else:
            expr = F.last(total, ignorenulls=True).over(before)
        carry.append(expr.alias(f"_c_{name}"))
    carried = work.groupBy(*keys, "_b").agg(*totals).select(*keys, "_b", *carry)
    # Null keys and null times are keys and buckets like any other, as they are for a window.
    names = {k: f"_k{i}" for i, k in enumerate(keys)} | {"_b": "_kb"}
    same = F.lit(True)
    for name, other in names.items():
        same = same & F.col(name).eqNullSafe(F.col(other))
    joined = work.join(carried.withColumnsRenamed(names), same)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order_names)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    result = []
    for name, (kind, _) in specs.items():
        value, start = F.col(f"_v_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            expr = start + F.coalesce(F.sum(value).over(so_far), F.lit(0))
        elif kind == "count":
            expr = start + F.count(value).over(so_far)
        elif kind == "max":
            expr = F.greatest(start, F.max(value).over(so_far))
        elif kind == "first":
            expr = F.when(start.isNotNull(), start["v"]).otherwise(F.first(value).over(so_far))
        elif kind == "prev":
            expr = F.when(F.row_number().over(inner) == 1, start["v"]).otherwise(F.lag(value).over(inner))
        else:
            expr = F.coalesce(F.last(value, ignorenulls=True).over(so_far), start)
        result.append(expr.alias(name))
    return joined.select(*df.columns, *result)


#: Rows of a key that one task scans at once, and rows looked at to choose the bounds of a block.
BLOCK_ROWS, SAMPLED = 1 << 19, 64
Specs = dict[str, tuple[str, Column]]


def scanned(df: DataFrame, keys: list[str], order: list[Column], specs: Specs, block: int = BLOCK_ROWS) -> DataFrame:
    """Add running columns in both directions, with any number of rows per key and time.

    ``specs`` maps a name to (kind, column): ``sum`` up to the row, ``sum_before`` it, ``max`` up to it, ``first`` value of the key, ``prev`` value
    one row earlier, ``last`` non-null value up to the row, ``last_before`` the one before it, ``next`` non-null value from the
    row on, ``total`` of the key. ``order`` makes rows unique within a key.
    """
    # Places are written with the rows: a row keeps its place however often it is read, even one that Spark numbers.
    names = [f"_p{i}" for i in range(len(order))]
    placed = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    return by_size(placed, keys, lambda rows, scan: scan(rows, [F.col(n) for n in names], specs), block).drop(*names)


def by_size(df: DataFrame, keys: list[str], steps: Callable, block: int = BLOCK_ROWS, write: bool = True, slices: Sequence[Column] = ()) -> DataFrame:
    """``steps(rows, scan)``, where ``scan(rows, order, specs)`` is :func:`scanned` by ``keys`` and may be used again on what it gave.

    Rows are written once, in ``slices`` as :func:`materialise` has them, or read again from ``df`` where that is cheap (``write`` false). Keys of at most ``block`` rows go by plain windows, and one
    exchange serves all scans of the steps. Larger keys, if there are any, go by blocks, see :func:`_by_blocks`. Steps keep the
    keys of rows and give no key more rows than it had, and ``order`` gives a row the same place each time.
    """
    rows = materialise(df, "scanned", FREED, slices=slices) if write else df
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > block)
    large = materialise(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "large-keys", FREED)
    if large.isEmpty():
        return steps(rows, lambda some, order, specs: _by_windows(some, keys, order, specs))
    same = _same({k: f"_k{i}" for i, k in enumerate(keys)})
    small, big = (rows.join(F.broadcast(large), same, how) for how in ("left_anti", "left_semi"))
    big = big if write else materialise(big, "large-rows", FREED)

    def blocks(some: DataFrame, order: list[Column], specs: Specs) -> DataFrame:
        return _by_blocks(some if some is big else materialise(some, "large-rows", FREED), keys, order, specs, block)

    return steps(small, lambda some, order, specs: _by_windows(some, keys, order, specs)).unionByName(steps(big, blocks))


def _same(names: dict[str, str]) -> Column:
    """Null-safe equality of pairs of columns: null keys are keys like any other, as they are for a window."""
    same = F.lit(True)
    for own, other in names.items():
        same = same & F.col(own).eqNullSafe(F.col(other))
    return same


def _within(kind: str, value: Column, keys: list[str], order: list[str]) -> Column:
    """The running value over rows of equal ``keys``; of ``prev`` a struct, which is null before the first row."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    so_far, earlier = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1)
    if kind in ("sum", "sum_before"):
        return F.coalesce(F.sum(value).over(so_far if kind == "sum" else earlier), F.lit(0))
    if kind == "max":
        return F.max(value).over(so_far)
    if kind == "first":
        return F.first(value).over(so_far)
    if kind == "prev":
        return F.lag(F.struct(value.alias("v"))).over(rows)
    if kind in ("last", "last_before"):
        return F.last(value, ignorenulls=True).over(so_far if kind == "last" else earlier)
    if kind == "next":
        # Read backwards: a frame that begins at the row and runs to the end would go over the rest of the rows for each row.
        return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0))
    if kind == "total":
        return F.sum(value).over(Window.partitionBy(*keys))
    raise ValueError(f"unknown kind {kind!r}")


def _by_windows(df: DataFrame, keys: list[str], order: list[Column], specs: Specs) -> DataFrame:
    """A scan of keys that fit into a task."""
    names = [f"_o{i}" for i in range(len(order))]
    work = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)], *[c.alias(f"_v_{n}") for n, (_, c) in specs.items()])
    found = {name: _within(kind, F.col(f"_v_{name}"), keys, names) for name, (kind, _) in specs.items()}
    return work.select(*df.columns, *[(c["v"] if specs[name][0] == "prev" else c).alias(name) for name, c in found.items()])


def _by_blocks(df: DataFrame, keys: list[str], order: list[Column], specs: Specs, block: int) -> DataFrame:
    """A scan of keys of any size; ``df`` is written and read three times.

    Bounds are chosen per key from rows picked by a hash, so blocks of a key have about ``block`` rows. Totals per block are carried
    over the blocks of a key and meet the rows of a block behind the one exchange by block.
    """
    names = [f"_o{i}" for i in range(len(order))]
    work = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)], *[c.alias(f"_v_{n}") for n, (_, c) in specs.items()])
    position = F.struct(*names)
    renamed = {k: f"_k{i}" for i, k in enumerate(keys)}
    every = max(1, block // SAMPLED)
    picked = work.where(F.pmod(F.xxhash64(*keys, *names), F.lit(every)) == 0).groupBy(*keys).agg(F.sort_array(F.collect_list(position)).alias("_all"))
    bounds = F.filter("_all", lambda x, i: i % (block // every) == block // every - 1)
    bounds = picked.select(*[F.col(k).alias(n) for k, n in renamed.items()], bounds.alias("_bounds"))
    # How many bounds lie before the row, by halving.
    search = """aggregate(sequence(length(bin(size(_bounds))) - 1, 0, -1), 0,
        (at, i) -> if(get(_bounds, at + shiftleft(1, i) - 1) < _at, at + shiftleft(1, i), at))"""
    rows = work.withColumn("_at", position).join(F.broadcast(bounds), _same(renamed), "left").withColumn("_b", F.coalesce(F.expr(search), F.lit(0))).select(*work.columns, "_b")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    totals, carries, inner, results = [], [], [], []
    for name, (kind, _) in specs.items():
        value, total, carried, found = F.col(f"_v_{name}"), F.col(f"_t_{name}"), F.col(f"_c_{name}"), F.col(f"_w_{name}")
        known = F.when(value.isNotNull(), position)
        if kind in ("sum", "sum_before"):
            parts = F.sum(value), F.coalesce(F.sum(total).over(before), F.lit(0)), carried + found
        elif kind == "max":
            parts = F.max(value), F.max(total).over(before), F.greatest(carried, found)
        elif kind == "first":
            parts = F.min_by(F.struct(value.alias("v")), position), F.first(total).over(before), F.when(carried.isNotNull(), carried["v"]).otherwise(found)
        elif kind == "prev":
            parts = F.max_by(F.struct(value.alias("v")), position), F.last(total).over(before), F.coalesce(found, carried)["v"]
        elif kind in ("last", "last_before"):
            parts = F.max_by(value, known), F.last(total, ignorenulls=True).over(before), F.coalesce(found, carried)
        elif kind == "next":
            parts = F.min_by(value, known), F.last(total, ignorenulls=True).over(after), F.coalesce(found, carried)
        elif kind == "total":
            parts = F.sum(value), F.sum(total).over(Window.partitionBy(*keys)), carried
        else:
            raise ValueError(f"unknown kind {kind!r}")
        totals.append(parts[0].alias(f"_t_{name}"))
        carries.append(parts[1].alias(f"_c_{name}"))
        if kind != "total":
            inner.append(_within(kind, value, [*keys, "_b"], names).alias(f"_w_{name}"))
        results.append(parts[2].alias(name))
    carried = rows.groupBy(*keys, "_b").agg(*totals).select(*keys, "_b", *carries).withColumnsRenamed(renamed | {"_b": "_kb"})
    within = rows.select(*df.columns, "_b", *inner)
    return within.join(F.broadcast(carried), _same(renamed | {"_b": "_kb"})).select(*df.columns, *results)


def framed(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    rows: int,
    exprs: dict[str, Callable[[WindowSpec], Column]],
    block: int = 4096,
) -> DataFrame:
    """Add aggregates over the last ``rows`` rows of each key (current row included).

    Rows are numbered per key, cut into blocks of ``block`` rows, and each block borrows the ``rows - 1`` rows before
    it, so no task holds more than ``block + rows`` rows of one key.
    """
    block = max(block, rows)
    numbered = running(df, keys, order, bucket, {"_n": ("count", F.lit(1))})
    own = F.floor((F.col("_n") - 1) / block)
    place = F.array(F.struct(own.alias("blk"), F.lit(False).alias("halo")))
    both = F.array(
        F.struct(own.alias("blk"), F.lit(False).alias("halo")), F.struct((own + 1).alias("blk"), F.lit(True).alias("halo"))
    )
    lends = (F.col("_n") - 1) % block >= block - (rows - 1)
    spread = numbered.select("*", F.explode(F.when(lends, both).otherwise(place)).alias("_p"))
    frame = Window.partitionBy(*keys, "_p.blk").orderBy("_n").rowsBetween(-(rows - 1), 0)
    computed = spread.select("*", *[fn(frame).alias(name) for name, fn in exprs.items()])
    return computed.where(~F.col("_p.halo")).drop("_n", "_p")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the 1-based position of each row within its key.

    Rows are dealt by ranges of (key, order), so a key is spread over as many tasks as its size asks for, and written once in
    that order; numbers start from how many rows of the key the ranges before hold. ``order`` must make rows unique within a key.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(width, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialise(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered", FREED).withColumn("_p", F.shiftright("_id", 33))
    spans = placed.groupBy(*keys, "_p").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    starts = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_kp"), shift.alias("_shift"))
    same = F.col("_p") == F.col("_kp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(starts, same).select(*df.columns, (F.col("_id") + F.col("_shift")).alias(name))


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many of those before it are smaller: a merge sort that counts, all merges of a level at once."""
    n = len(values)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    at, out, half = np.arange(n), np.zeros(n, np.int64), 1
    while half < n:
        pair, right = at // (2 * half), (at // half) % 2 == 1
        left = np.sort(pair[~right] * (n + 1) + ranks[~right])
        own = pair[right] * (n + 1)
        out[right] += np.searchsorted(left, own + ranks[right]) - np.searchsorted(left, own)
        half *= 2
    return out
