"""Series cards, trends, z-scores, anomalies and composite signals over long panels.

Inputs are at calendar grain (one row per key and date), so windows per key are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import PLAUSIBLE_RANGES, PROXY_SPREAD, PROXY_VOTES
from tidemark.functions import labels as L
from tidemark.functions.thresholds import threshold_label

SERIES = ("entity_id", "series_id")


def pct_of(change: Column, base: Column) -> Column:
    """Percent of the absolute base; null when the base is zero."""
    return F.when(base != 0, change / F.abs(base) * 100)


def from_end(keys: Sequence[str], time: str) -> Column:
    """1 for the last row of a key, 2 for the one before, and so on."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc()))


def latest_and_prior(obs: DataFrame, keys: Sequence[str] = SERIES, time: str = "obs_date", value: str = "value") -> DataFrame:
    """Latest and prior value with changes, year-on-year change by as-of date, percentile of the latest and count."""
    w = Window.partitionBy(*keys)
    last = F.max(time).over(w)
    marked = obs.select(*keys, time, value, last.alias("_last"), F.max_by(value, time).over(w).alias("_latest"))
    earlier = F.when(F.col(time) < F.col("_last"), F.col(time))
    year_ago = F.when(F.col(time) <= F.date_sub("_last", 365), F.col(time))
    card = marked.groupBy(*keys).agg(
        F.max_by(value, time).alias("latest_value"),
        F.max(time).alias("latest_date"),
        F.max_by(value, earlier).alias("prior_value"),
        F.max(earlier).alias("prior_date"),
        F.max_by(value, year_ago).alias("year_ago_value"),
        F.avg((F.col(value) < F.col("_latest")).cast("double")).alias("_below"),
        F.count("*").alias("n"),
    )
    change = F.col("latest_value") - F.col("prior_value")
    return card.select(
        *keys,
        "latest_value",
        "latest_date",
        "prior_value",
        "prior_date",
        change.alias("change_abs"),
        pct_of(change, F.col("prior_value")).alias("change_pct"),
        pct_of(F.col("latest_value") - F.col("year_ago_value"), F.col("year_ago_value")).alias("yoy_pct"),
        F.when(F.col("n") >= 10, F.col("_below") * 100).alias("percentile"),
        "n",
    )


def positional_change(
    prices: DataFrame, keys: Sequence[str], time: str, value: str, back: Sequence[int] = (5, 21, 65)
) -> DataFrame:
    """Percent change of the last value against the value ``k`` rows earlier, clamped to the first row."""
    w = Window.partitionBy(*keys)
    placed = prices.select(*keys, time, value, from_end(keys, time).alias("_pos"), F.count("*").over(w).alias("_n"))
    picked = placed.groupBy(*keys).agg(
        F.max(time).alias("latest_date"),
        F.max(F.when(F.col("_pos") == 1, F.col(value))).alias("latest_value"),
        *[F.max(F.when(F.col("_pos") == F.least(F.lit(k + 1), F.col("_n")), F.col(value))).alias(f"_b{k}") for k in back],
    )
    return picked.select(
        *keys,
        "latest_date",
        "latest_value",
        *[pct_of(F.col("latest_value") - F.col(f"_b{k}"), F.col(f"_b{k}")).alias(f"change_{k}_pct") for k in back],
    )


def percentile_of_latest(
    obs: DataFrame, keys: Sequence[str] = SERIES, time: str = "obs_date", value: str = "value", mode: str = "lt", min_n: int = 10
) -> DataFrame:
    """Share of values strictly below (``lt``) or at most (``le``) the latest one, times 100."""
    latest = F.max_by(value, time).over(Window.partitionBy(*keys))
    marked = obs.select(*keys, time, value, latest.alias("_latest"))
    below = F.col(value) < F.col("_latest") if mode == "lt" else F.col(value) <= F.col("_latest")
    return marked.groupBy(*keys).agg(
        F.max_by(value, time).alias("latest_value"),
        F.when(F.count("*") >= min_n, F.avg(below.cast("double")) * 100).alias("percentile"),
    )


def moments(obs: DataFrame, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Count, mean and sum of squared deviations per key."""
    return obs.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")
    )


def merge_moments(state: DataFrame, batch: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Pairwise merge of two moment tables."""
    a = state.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("n", "mean", "m2")])
    z = batch.select(*keys, *[F.col(c).alias(f"z_{c}") for c in ("n", "mean", "m2")])
    zero = F.lit(0.0)
    na, nz = F.coalesce("a_n", F.lit(0)), F.coalesce("z_n", F.lit(0))
    delta = F.coalesce("z_mean", zero) - F.coalesce("a_mean", zero)
    total = na + nz
    return a.join(z, list(keys), "full_outer").select(
        *keys,
        total.alias("n"),
        F.when(na == 0, F.col("z_mean")).otherwise(F.col("a_mean") + F.when(nz > 0, delta * nz / total).otherwise(zero)).alias("mean"),
        (F.coalesce("a_m2", zero) + F.coalesce("z_m2", zero) + F.when((na > 0) & (nz > 0), delta * delta * na * nz / total).otherwise(zero)).alias("m2"),
    )


def z_scores(
    obs: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str] = SERIES,
    time: str = "obs_date",
    value: str = "value",
    roc_rows: int = 8,
    threshold: float = 2.0,
) -> DataFrame:
    """Level, long-term and rate-of-change z of the latest value; rows where any passes the threshold are flagged.

    The long-term z uses the stored baseline as it was before the latest value is folded in.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    changes = obs.select(*keys, time, value, (F.col(value) - F.lag(value, roc_rows).over(w)).alias("_d"))
    card = changes.groupBy(*keys).agg(
        F.max_by(value, time).alias("latest_value"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.count("*").alias("n"),
        F.max_by("_d", time).alias("_d"),
        F.avg("_d").alias("_dm"),
        F.stddev_pop("_d").alias("_ds"),
        F.count("_d").alias("_dn"),
    )
    base = baseline.select(*keys, F.col("n").alias("baseline_n"), F.col("mean").alias("_bm"), F.sqrt(F.col("m2") / F.col("n")).alias("_bs"))
    scored = card.where((F.col("n") >= 10) & (F.col("std") >= 1e-6)).join(base, list(keys), "left").select(
        *keys,
        "latest_value",
        "mean",
        "std",
        F.coalesce("baseline_n", F.lit(0)).alias("baseline_n"),
        ((F.col("latest_value") - F.col("mean")) / F.col("std")).alias("level_z"),
        F.when((F.col("baseline_n") >= 20) & (F.col("_bs") > 1e-6), (F.col("latest_value") - F.col("_bm")) / F.col("_bs")).alias("long_term_z"),
        F.when((F.col("n") >= roc_rows + 3) & (F.col("_dn") >= 3) & (F.col("_ds") > 1e-6), (F.col("_d") - F.col("_dm")) / F.col("_ds")).alias("roc_z"),
    )
    named = [("level_z", "level"), ("long_term_z", "long_term"), ("roc_z", "rate_of_change")]
    reasons = [F.when(F.abs(F.col(z)) >= threshold, word) for z, word in named]
    return scored.select(
        "*",
        F.concat_ws("+", *reasons).alias("flag_reason"),
        F.when(F.col("latest_value") > F.col("mean"), "above_mean").otherwise("below_mean").alias("direction"),
        F.when(F.col("roc_z") > 0, "accelerating").when(F.col("roc_z").isNotNull(), "decelerating").alias("roc_direction"),
        F.greatest(*[F.abs(F.col(z)) for z, _ in named]).alias("max_z"),
    )


def tensions(scored: DataFrame) -> DataFrame:
    """Flagged series, strongest first."""
    return scored.where(F.col("flag_reason") != "").orderBy(F.col("max_z").desc(), *SERIES)


def rolling_trend(
    obs: DataFrame, windows: Sequence[int] = (4, 8), keys: Sequence[str] = SERIES, time: str = "obs_date", value: str = "value"
) -> DataFrame:
    """Direction of the last ``w`` changes per window: counts, cumulative change, label."""
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(time)
    placed = obs.select(
        *keys,
        time,
        value,
        from_end(keys, time).alias("_pos"),
        F.count("*").over(w).alias("_n"),
        (F.col(value) - F.lag(value).over(ordered)).alias("_d"),
    ).where((F.col("_n") >= max(windows) + 1) & (F.col("_pos") <= max(windows) + 1))
    spread = placed.select("*", F.explode(F.array(*[F.lit(x) for x in windows])).alias("window")).where("_pos <= window + 1")
    inside = F.col("_pos") <= F.col("window")
    agg = spread.groupBy(*keys, "window").agg(
        F.count(F.when(inside & (F.col("_d") > 0), 1)).alias("up"),
        F.count(F.when(inside & (F.col("_d") < 0), 1)).alias("down"),
        F.count(F.when(inside & (F.col("_d") == 0), 1)).alias("flat"),
        F.max(F.when(F.col("_pos") == F.col("window") + 1, F.col(value))).alias("_base"),
        F.max(F.when(F.col("_pos") == 1, F.col(value))).alias("_last"),
        F.min(time).alias("start_date"),
        F.max(time).alias("end_date"),
    )
    change = F.col("_last") - F.col("_base")
    pct = F.when(F.col("_base") != 0, F.abs(change / F.col("_base") * 100)).otherwise(0.0)
    return agg.select(
        *keys,
        "window",
        "up",
        "down",
        "flat",
        change.alias("cumulative"),
        pct.alias("cumulative_pct"),
        L.case(
            (pct < 0.05, "neutral"),
            (F.col("up") >= F.col("window") * 0.75, "expansion_bias"),
            (F.col("down") >= F.col("window") * 0.75, "contraction_bias"),
            (F.col("up") > F.col("down"), "mixed_positive"),
            (F.col("down") > F.col("up"), "mixed_negative"),
            default="neutral",
        ).alias("direction"),
        "start_date",
        "end_date",
    )


def ma_momentum(prices: DataFrame, keys: Sequence[str], time: str, value: str, fast: int = 13, slow: int = 26) -> DataFrame:
    """Last price against its fast and slow trailing means; keys with fewer than ``slow`` rows give no row."""
    w = Window.partitionBy(*keys).orderBy(time)
    placed = prices.select(
        *keys,
        time,
        value,
        F.avg(value).over(w.rowsBetween(-(fast - 1), 0)).alias("fast_mean"),
        F.avg(value).over(w.rowsBetween(-(slow - 1), 0)).alias("slow_mean"),
        F.count("*").over(w.rowsBetween(-(slow - 1), 0)).alias("_n"),
    )
    last = placed.groupBy(*keys).agg(F.max_by(F.struct(value, "fast_mean", "slow_mean", "_n"), time).alias("r"))
    above_fast, above_slow = F.col(value) > F.col("fast_mean"), F.col(value) > F.col("slow_mean")
    return last.select(*keys, "r.*").where(F.col("_n") >= slow).select(
        *keys,
        value,
        "fast_mean",
        "slow_mean",
        L.case(
            (above_fast & above_slow, "strong_uptrend"), (above_slow, "weakening"), (above_fast, "recovering"), default="downtrend"
        ).alias("momentum"),
        ((F.col(value) - F.col("slow_mean")) / F.col("slow_mean") * 100).alias("pct_above_slow"),
    )


def spread_trend(pair: DataFrame, keys: Sequence[str], time: str, spread: str = "spread", take: int = 30) -> DataFrame:
    """Mean of the last five against the first five of the last ``take`` common dates; under ten dates give no label."""
    placed = pair.select(*keys, time, spread, from_end(keys, time).alias("_pos")).where(F.col("_pos") <= take)
    counted = placed.select("*", F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    agg = counted.groupBy(*keys, "n").agg(
        F.avg(F.when(F.col("_pos") <= 5, F.col(spread))).alias("late"),
        F.avg(F.when(F.col("_pos") > F.col("n") - 5, F.col(spread))).alias("early"),
    )
    return agg.select(
        *keys,
        "n",
        "early",
        "late",
        F.when(
            F.col("n") >= 10,
            L.case(
                (F.col("late") > F.col("early") + 0.5, "narrowing_to_wti_premium"), (F.col("late") < F.col("early") - 0.5, "widening_brent_premium"), default="stable"
            ),
        ).alias("trend"),
    )


def range_anomalies(cards: DataFrame, series: str = "series_id", value: str = "latest_value") -> DataFrame:
    """Values outside their plausible range, with severity. The range table is a literal map, not a join."""
    ranges = F.create_map(
        *[x for s, (lo, hi) in PLAUSIBLE_RANGES.items() for x in (F.lit(s), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))]
    )
    found = cards.select("*", ranges[F.col(series)].alias("_r"))
    lo, hi, v = F.col("_r.lo"), F.col("_r.hi"), F.col(value)
    high = (v < lo * 0.5) | (v > hi * 2)
    return (
        found.where((v < lo) | (v > hi))
        .select("*", lo.alias("lo"), hi.alias("hi"), F.when(high, "high").otherwise("medium").alias("severity"))
        .drop("_r")
    )


def nest_cards(obs: DataFrame, keys: Sequence[str] = SERIES, time: str = "obs_date", value: str = "value", points: int = 52) -> DataFrame:
    """One row per series with its last ``points`` observations as an array, oldest first."""
    placed = obs.select(*keys, time, value, from_end(keys, time).alias("_pos")).where(F.col("_pos") <= points)
    return placed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(time).alias("date"), F.col(value).alias("value")))).alias("history")
    )


def tail(obs: DataFrame, n: int, keys: Sequence[str] = SERIES, time: str = "obs_date") -> DataFrame:
    """Last ``n`` rows per key."""
    return obs.select("*", from_end(keys, time).alias("_pos")).where(F.col("_pos") <= n).drop("_pos")


def positioning(net: DataFrame, key: str, time: str, value: str, min_n: int = 10) -> DataFrame:
    """Latest net position with its change, percentile, crowding label and direction."""
    card = latest_and_prior(net.select(key, F.col(time).alias("obs_date"), F.col(value).alias("value")), [key])
    pct = F.when(F.col("n") >= min_n, F.col("percentile"))
    return card.select(
        key,
        F.col("latest_value").alias("net"),
        F.col("change_abs").alias("change"),
        pct.alias("percentile"),
        L.positioning_label(pct).alias("crowding"),
        L.positioning_direction(F.col("latest_value"), F.col("change_abs")).alias("direction"),
    )


def diffusion_composite(signals: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Expanding against contracting surveys, their mean, consensus and conviction."""
    v = F.col(value)
    agg = signals.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.when(v > 0, 1)).alias("expanding"),
        F.count(F.when(v < 0, 1)).alias("contracting"),
        F.count("*").alias("total"),
        F.avg(v).alias("average"),
    )
    size = F.abs("average")
    return agg.select(
        "*",
        L.case(
            (F.col("expanding") > F.col("contracting"), "expansion"),
            (F.col("contracting") > F.col("expanding"), "contraction"),
            default="mixed",
        ).alias("consensus"),
        L.case((size < 2, "marginal"), (size < 10, "moderate"), default="strong").alias("conviction"),
    )


def proxy_convergence(proxies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stress and easing votes over a long (metric, value) table; a call needs two agreeing proxies and no tie."""
    stress, easing = F.lit(False), F.lit(False)
    for metric, (bad, good) in PROXY_VOTES.items():
        label, here = threshold_label(F.col("value"), metric), F.col("metric") == metric
        stress, easing = stress | (here & label.isin(*bad)), easing | (here & label.isin(*good))
    wide, narrow = PROXY_SPREAD
    spread = F.col("metric") == "hy_spread"
    stress, easing = stress | (spread & (F.col("value") > wide)), easing | (spread & (F.col("value") < narrow))
    agg = proxies.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.count(F.when(stress, 1)).alias("stress"), F.count(F.when(easing, 1)).alias("easing"), F.count("*").alias("total")
    )
    s, e = F.col("stress"), F.col("easing")
    return agg.select(
        *keys,
        "stress",
        "easing",
        (F.col("total") - s - e).alias("neutral"),
        "total",
        L.case(
            ((s >= 2) & (s > e), "stress — majority of proxies converging"),
            ((e >= 2) & (e > s), "benign — majority of proxies converging"),
            (F.col("total") <= 1, "insufficient data — need at least 2 proxies for directional call"),
            ((s > 0) & (s == e), "inconclusive — proxies actively diverging (stress and easing signals present)"),
            default="inconclusive — no clear signal",
        ).alias("composite"),
    )


def cross_entity_divergence(labelled: DataFrame, time: str, home: str) -> DataFrame:
    """Home entity against the others per date: aligned or diverging, and how many slow down at once."""
    slow = F.col("label").isin("decelerating", "contracting")
    away = F.col("entity_id") != home
    agg = labelled.where(F.col("label").isNotNull()).groupBy(time).agg(
        F.count(F.when(slow, 1)).alias("decelerating"),
        F.count(F.when(slow & away, 1)).alias("_slow_away"),
        F.count(F.when(away, 1)).alias("_away"),
        F.max(F.when(~away, F.col("label"))).alias("home_label"),
    )
    up = F.coalesce(F.col("home_label").isin("expanding", "recovering"), F.lit(False))
    world_down = F.col("_slow_away") >= F.col("_away") / 2
    return agg.select(
        time,
        "decelerating",
        "home_label",
        L.case((up & world_down, "diverging_up"), (~up & ~world_down, "diverging_down"), default="aligned").alias("home_vs_world"),
        (F.col("decelerating") >= 3).alias("simultaneous"),
    )


def group_gap(df: DataFrame, keys: Sequence[str], group: str, value: str, a: str, b: str, gap: float = 3.0) -> DataFrame:
    """Two named groups side by side and whether they differ by more than ``gap``."""
    agg = df.groupBy(*keys).agg(
        F.avg(F.when(F.col(group) == a, F.col(value))).alias("a_value"),
        F.avg(F.when(F.col(group) == b, F.col(value))).alias("b_value"),
    )
    return agg.select("*", F.coalesce(F.abs(F.col("a_value") - F.col("b_value")) > gap, F.lit(False)).alias("diverging"))


def systemic(ranked: DataFrame, keys: Sequence[str], label: str = "heat", at_least: int = 3) -> DataFrame:
    """How many entities overheat and whether that is systemic."""
    hot = F.count(F.when(F.col(label) == "overheating", 1))
    return ranked.groupBy(*keys).agg(hot.alias("overheating"), (hot >= at_least).alias("systemic"))


def latest_per_field(records: DataFrame, key: str, field: str, year: str, value: str, fields: Sequence[str]) -> DataFrame:
    """Newest non-null value of each field per key, one column per field."""
    known = F.col(value).isNotNull()
    return records.groupBy(key).agg(
        *[F.max_by(value, F.when((F.col(field) == f) & known, F.col(year))).alias(f) for f in fields]
    )


def surprise(df: DataFrame, keys: Sequence[str], time: str, actual: str, consensus: str, rows: int = 4) -> DataFrame:
    """Sign and size of actual against consensus, and the mean sign of the last ``rows`` releases."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(rows - 1), 0)
    gap = F.col(actual) - F.col(consensus)
    return df.select("*", gap.alias("surprise"), F.signum(gap).alias("sign")).select("*", F.avg("sign").over(w).alias("trend"))


def weighted_score(long: DataFrame, keys: Sequence[str], weights: dict[str, float], name: str = "indicator", value: str = "value") -> DataFrame:
    """Weighted mean over the available indicators, clipped to [-1, 1]."""
    table = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
    weighed = long.where(F.col(value).isNotNull() & F.col(name).isin(list(weights))).select(*keys, value, table[F.col(name)].alias("_w"))
    score = F.sum(F.col("_w") * F.col(value)) / F.sum("_w")
    return weighed.groupBy(*keys).agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("score"))
