"""Label expressions: each takes Columns and returns a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EM_DASH = " — "
FAMILIES = ("Goldilocks", "Overheating", "Disinflationary Slowdown", "Stagflation")
LABELS_8 = tuple(f"{family}{EM_DASH}{side} Liquidity" for family in FAMILIES for side in ("Ample", "Tight"))


def case(*branches: tuple[Column, object], default: object = None) -> Column:
    """``CASE WHEN`` from (condition, result) pairs."""
    expr = None
    for condition, result in branches:
        expr = F.when(condition, result) if expr is None else expr.when(condition, result)
    return expr.otherwise(default)


def mean_of(cols: list[Column]) -> Column:
    """Mean of the non-null columns of a row; null when all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def vote_mean(votes: Column) -> Column:
    """Null-skipping mean of an ARRAY<DOUBLE>."""
    kept = F.filter(votes, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(kept) > 0, total / F.size(kept))


def axis_direction(score: Column) -> Column:
    """``rising`` above zero, ``falling`` otherwise; null stays null."""
    return F.when(score > 0, "rising").when(score.isNotNull(), "falling")


def family(growth: Column, inflation: Column) -> Column:
    """Four-quadrant label of two directions."""
    return case(
        ((growth == "rising") & (inflation == "falling"), "Goldilocks"),
        ((growth == "rising") & (inflation == "rising"), "Overheating"),
        ((growth == "falling") & (inflation == "falling"), "Disinflationary Slowdown"),
        ((growth == "falling") & (inflation == "rising"), "Stagflation"),
    )


def label8(family_col: Column, liquidity: Column) -> Column:
    """Family plus liquidity side; the bare family where liquidity is unknown."""
    side = F.when(liquidity == "loose", "Ample").otherwise("Tight")
    return F.when(family_col.isNull() | liquidity.isNull(), family_col).otherwise(
        F.concat(family_col, F.lit(EM_DASH), side, F.lit(" Liquidity"))
    )


def family_of(label: Column) -> Column:
    """The family part of a label."""
    return F.split(label, EM_DASH)[0]


def has_liquidity_suffix(label: Column) -> Column:
    """True where a label carries its liquidity side."""
    return label.rlike("(Ample|Tight) Liquidity$")


def liquidity_binary(score: Column) -> Column:
    """``loose`` above one half, ``tight`` otherwise; null stays null."""
    return F.when(score > 0.5, "loose").when(score.isNotNull(), "tight")


def liquidity_level(score: Column) -> Column:
    """Four levels; an unknown score reads as the tightest one."""
    return case((score >= 0.8, "strong_loose"), (score > 0.5, "loose"), (score > 0.2, "tight"), default="strong_tight")


def two_axis_label(level: Column, change: Column, pivot: float = 100.0) -> Column:
    """Position against the pivot and sign of the change."""
    return case(
        ((level >= pivot) & (change > 0), "expanding"),
        (level >= pivot, "decelerating"),
        (change > 0, "recovering"),
        (level.isNotNull() & change.isNotNull(), "contracting"),
    )


def flow_label(change_a: Column, change_b: Column) -> Column:
    """Two drains on liquidity: both down injects twice, one down injects, both up drains twice."""
    return case(
        (change_a.isNull() | change_b.isNull(), "neutral"),
        ((change_a < 0) & (change_b < 0), "double injection"),
        ((change_a < 0) | (change_b < 0), "net injection"),
        ((change_a > 0) & (change_b > 0), "double drain"),
        default="net drain",
    )


def positioning_label(percentile: Column) -> Column:
    """Crowding of a position from its percentile."""
    return case(
        (percentile >= 90, "extreme long"),
        (percentile <= 10, "extreme short"),
        (percentile >= 80, "crowded long"),
        (percentile <= 20, "crowded short"),
    )


def positioning_direction(net: Column, change: Column) -> Column:
    """Whether a net position is being built or unwound."""
    return F.when(
        change.isNotNull(),
        case(
            ((net > 0) & (change > 0), "building long"),
            ((net > 0) & (change < 0), "unwinding long"),
            ((net < 0) & (change < 0), "building short"),
            ((net < 0) & (change > 0), "unwinding short"),
            default="flat",
        ),
    )


def percentile_label(rank: Column) -> Column:
    """Five heat levels of a 0-100 rank."""
    return case(
        (rank > 90, "overheating"),
        (rank > 70, "hot"),
        (rank > 30, "moderate"),
        (rank > 10, "cooling"),
        (rank.isNotNull(), "declining"),
    )


def change_direction(change: Column, up: str, down: str, flat: str = "stable") -> Column:
    """Word for the sign of a change."""
    return case((change > 0, up), (change < 0, down), (change.isNotNull(), flat))
