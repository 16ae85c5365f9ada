"""Decision tables: templates, limits, reconciliation, gates, verdicts, forecasts.

Windows here run over the sectors of an account or the months of an entity, both bounded by their nature; positions of an
account and anything at event grain use :mod:`tidemark.operators.scans`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import LIMITS, MIN_CASH_SYMBOL, TEMPLATE_TOTAL, TEMPLATES, TILT_GROUPS, TILTS
from tidemark.functions import labels as L
from tidemark.operators.scans import BLOCK_ROWS, by_size, scanned


def template_rows(families: DataFrame, family: str = "regime", liquidity: str = "liquidity_binary") -> DataFrame:
    """Template of each row's family with the tilt of its liquidity side; zero buckets carry no tilt."""
    bucket = lambda b, s, w: F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("symbol"), F.lit(float(w)).alias("weight"))
    table = F.create_map(*[x for f, rows in TEMPLATES.items() for x in (F.lit(f), F.array(*[bucket(*r) for r in rows]))])
    rows = families.select("*", F.inline(table[F.col(family)]))
    side = F.when(F.col(liquidity) == "loose", "ample").when(F.col(liquidity).isNotNull(), "tight")
    branches = [
        ((side == name) & F.col("symbol").isin(*symbols), F.lit(TILTS[name][group]))
        for name in TILTS
        for group, symbols in TILT_GROUPS.items()
    ]
    tilt = F.when(F.col("weight") > 0, L.case(*branches, default=0.0)).otherwise(0.0)
    return rows.select("*", tilt.alias("tilt"))


def tilted_template(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tilted weights, floored and rescaled to the template total."""
    floor = F.when((F.col("symbol").isin(*TILT_GROUPS["cash"])) & (F.col("weight") > 0), MIN_CASH_SYMBOL).otherwise(0.0)
    raised = rows.select("*", F.greatest(floor, F.col("weight") + F.col("tilt")).alias("_w"))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    return raised.select("*", (F.col("_w") / total * TEMPLATE_TOTAL).alias("target_pct")).drop("_w")


def tradeable(status: Column) -> Column:
    """Share of the stated size a thesis may trade at."""
    return L.case((status.isin("ACTIVE", "STRENGTHENING"), 1.0), (status == "WEAKENING", 0.5), default=0.0)


def thesis_overlay(theses: DataFrame) -> DataFrame:
    """One row per expression, sized from its stated range: top, bottom or middle by status."""
    rows = theses.select("thesis_id", "status", F.inline("expressions"))
    lo = F.regexp_extract("sizing", r"(\d+(?:\.\d+)?)\s*-", 1).cast("double")
    hi = F.regexp_extract("sizing", r"-\s*(\d+(?:\.\d+)?)\s*%", 1).cast("double")
    size = L.case((F.col("status") == "STRENGTHENING", hi), (F.col("status") == "WEAKENING", lo), default=(lo + hi) / 2)
    return rows.select(
        "thesis_id", "status", "symbol", "expression_order", size.alias("size_pct"), (tradeable(F.col("status")) > 0).alias("tradeable")
    ).where("tradeable")


def halve_avoided(template: DataFrame, avoided: DataFrame) -> DataFrame:
    """Template weights of avoided symbols halved."""
    marked = avoided.select("symbol").distinct().select("symbol", F.lit(True).alias("_a"))
    hit = F.coalesce("_a", F.lit(False))
    return template.join(marked, "symbol", "left").select(
        *template.columns, hit.alias("conflict"), F.when(hit, F.col("weight") / 2).otherwise(F.col("weight")).alias("adjusted")
    )


def apply_limits(target: DataFrame, account: str = "account_id") -> DataFrame:
    """Position, sector, overlay and cash limits in that order, each a proportional scale-down; logs what it touched.

    Every scale follows from the sums per (account, sector), which are made map-side; windows see sectors only, so an account may
    hold any number of positions.
    """
    one, thesis = F.lit(1.0), F.col("thesis") != ""
    capped = target.select("*", F.least(F.col("target_pct"), F.lit(LIMITS["position"])).alias("_p1"))
    sums = capped.groupBy(F.col(account).alias("_acc"), F.col("sector").alias("_sec")).agg(
        F.sum("_p1").alias("_all"), F.coalesce(F.sum(F.when(thesis, F.col("_p1"))), F.lit(0.0)).alias("_tilt")
    )
    acc, equity = Window.partitionBy("_acc"), F.col("_sec").isNotNull()
    total_equity = F.sum(F.when(equity, F.col("_all"))).over(acc)
    sector = F.when(equity, F.least(one, F.try_divide(total_equity * LIMITS["sector"] / 100, F.col("_all")))).otherwise(one)
    step = sums.select("*", sector.alias("_cut"))
    overlay = F.least(one, F.try_divide(F.lit(LIMITS["overlay"]), F.sum(F.col("_cut") * F.col("_tilt")).over(acc)))
    step = step.select("*", overlay.alias("_over"))
    step = step.select("*", (F.col("_cut") * (F.col("_all") - F.col("_tilt") + F.col("_tilt") * F.col("_over"))).alias("_p3s"))
    step = step.select("*", F.least(one, F.try_divide(F.lit(100 - LIMITS["cash"]), F.sum("_p3s").over(acc))).alias("_cash"))
    kept = F.when(equity, F.col("_p3s") * F.col("_cash"))
    share = F.try_divide(kept, F.sum(kept).over(acc))
    scales = step.select("_acc", "_sec", "_cut", "_over", "_cash", share.alias("_share"))
    rows = capped.join(scales, F.col(account).eqNullSafe(F.col("_acc")) & F.col("sector").eqNullSafe(F.col("_sec")))
    rows = rows.select("*", (F.col("_p1") * F.col("_cut")).alias("_p2"))
    rows = rows.select("*", F.when(thesis, F.col("_p2") * F.col("_over")).otherwise(F.col("_p2")).alias("_p3"))
    rows = rows.select("*", (F.col("_p3") * F.col("_cash")).alias("limited_pct"))
    less = lambda a, z: F.col(z) < F.col(a) - 1e-9
    return rows.select(
        *target.columns,
        "limited_pct",
        F.concat_ws(
            ",",
            F.when(less("target_pct", "_p1"), "position"),
            F.when(less("_p1", "_p2"), "sector"),
            F.when(less("_p2", "_p3"), "overlay"),
            F.when(less("_p3", "limited_pct"), "cash"),
        ).alias("corrections"),
        F.coalesce(F.col("_share") > LIMITS["sector"] / 100 + 1e-6, F.lit(False)).alias("residual_sector"),
    )


def target_vs_current(target: DataFrame, current: DataFrame, keys: Sequence[str] = ("account_id", "symbol")) -> DataFrame:
    """Full outer join of target and current shares with the difference."""
    t = target.select(*keys, F.col("pct").alias("target_pct"))
    c = current.select(*keys, F.col("pct").alias("current_pct"))
    both = t.join(c, list(keys), "full_outer").na.fill(0.0, ["target_pct", "current_pct"])
    return both.select("*", (F.col("target_pct") - F.col("current_pct")).alias("delta_pct"))


def reconcile(both: DataFrame, kill: Column, layer: Column) -> DataFrame:
    """Action, priority and orphan reason per (account, symbol); a kill switch overrides everything.

    What a closed thesis left is closed, what a former regime left is sold gradually, and anything else is for review.
    """
    held, wanted = F.col("current_pct") > 0, F.col("target_pct") > 0
    killed = kill & held
    delta = F.when(killed, -F.col("current_pct")).otherwise(F.col("delta_pct"))
    action = L.case(
        (killed, "EXIT_KILL_SWITCH"),
        (~held & wanted, "NEW_POSITION"),
        (held & ~wanted & (layer == "regime"), "SELL_SOME"),
        (held & ~wanted & layer.startswith("thesis"), "CLOSE"),
        (held & ~wanted, "REVIEW"),
        (delta > 1e-9, "BUY_MORE"),
        (delta < -1e-9, "SELL_SOME"),
        default="HOLD",
    )
    reason = F.when(
        held & ~wanted,
        L.case((killed, "kill switch"), (layer.startswith("thesis"), "thesis closed"), (layer == "regime", "prior regime"), default="manual review"),
    ).otherwise("")
    priority = L.case((killed, "URGENT"), (F.abs(delta) < LIMITS["min_delta"], "LOW"), default="NORMAL")
    return both.select(
        "account_id",
        "symbol",
        F.when(killed, 0.0).otherwise(F.col("target_pct")).alias("target_pct"),
        "current_pct",
        delta.alias("delta_pct"),
        action.alias("action"),
        priority.alias("priority"),
        reason.alias("orphan_reason"),
    )


def kill_switches(rules: list[tuple[str, str, str, float, int]], monthly: DataFrame) -> DataFrame:
    """Proximity of each entity to each (name, series, op, threshold, consecutive) rule.

    The rule list is a literal array matched by series; streaks come from the row after the last breach-free month.
    """
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("rule"), F.lit(s).alias("rule_series"), F.lit(o).alias("op"), F.lit(t).alias("threshold"), F.lit(c).alias("consecutive"))
            for n, s, o, t, c in rules
        ]
    )
    wanted = F.filter(rows, lambda r: r["rule_series"] == F.col("series_id"))
    spread = monthly.select("entity_id", "month", "series_id", "value", F.inline(wanted))
    breach = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    back = F.row_number().over(Window.partitionBy("entity_id", "rule").orderBy(F.col("month").desc()))
    placed = spread.select("*", breach.alias("_hit"), back.alias("_pos"))
    agg = placed.groupBy("entity_id", "rule", "series_id", "op", "threshold", "consecutive").agg(
        F.max(F.when(F.col("_pos") == 1, F.col("value"))).alias("value"),
        (F.coalesce(F.min(F.when(~F.col("_hit"), F.col("_pos"))), F.count("*") + 1) - 1).alias("streak"),
    )
    # How much of the way to the threshold is gone. Below zero the two directions change places, and zero has no way to it.
    rising = (F.col("op") == ">") == (F.col("threshold") > 0)
    ratio = F.when(F.col("threshold") != 0, F.when(rising, F.try_divide("value", "threshold")).otherwise(F.try_divide("threshold", "value")))
    proximity = L.case(
        (F.col("streak") >= F.col("consecutive"), "TRIGGERED"), (ratio >= 0.8, "NEAR"), (ratio >= 0.6, "APPROACHING"), default="FAR"
    )
    return agg.select("entity_id", "rule", "series_id", "value", "streak", proximity.alias("proximity")).select(
        "*", L.case((F.col("proximity") == "TRIGGERED", "EXIT_IMMEDIATELY"), (F.col("proximity") == "FAR", "none"), default="monitor").alias("action")
    )


def scale_in(orders: DataFrame) -> DataFrame:
    """Executed share of each delta by layer, status and run; tiny deltas are skipped, large adjustments split."""
    layer, status, run = F.col("layer"), F.col("status"), F.col("run")
    share = L.case(
        ((status == "STRENGTHENING") & (run == 1), 0.75),
        ((layer == "thesis_structural") & (run == 1), 0.33),
        ((layer == "thesis_structural") & (run == 2), 0.66),
        ((layer == "thesis_tactical") & (run == 1), 0.5),
        ((layer == "regime") & (run == 1) & (F.col("regime") == "Stagflation"), 0.75),
        ((layer == "regime") & (run == 1), 0.5),
        default=1.0,
    )
    size = F.abs("delta_pct")
    return orders.select(
        "*",
        L.case((size < LIMITS["min_delta"], "skip"), (size > LIMITS["split_delta"], "split"), default="trade").alias("mode"),
        F.when(size < LIMITS["min_delta"], 0.0).otherwise(F.col("delta_pct") * share).alias("execute_pct"),
    )


def retry_gate(orders: DataFrame) -> DataFrame:
    """Two expired attempts: skip a weak conviction, widen a strong one, send an exit to market."""
    gated = F.col("retry_count") >= 2
    conviction = F.col("conviction")
    action = L.case(
        (~gated, "retry"),
        (conviction.isin("bear", "strong sell"), "market"),
        (conviction.isin("favor", "bull"), "retry"),
        default="skip",
    )
    return orders.select("*", action.alias("gate")).select(
        "*", F.when(F.col("gate") == "retry", (F.col("retry_count") + 1) * LIMITS["buffer"]).alias("widen_pct")
    )


#: Thesis states that count as a favourable signal when an order is tried again; all others count as neutral.
STANDING = ("ACTIVE", "STRENGTHENING")
#: Orders of these priorities (kill switch, drawdown) always go to market.
FORCED_PRIORITY = 2


def retry_signal(layer: Column, signal: Column, status: Column) -> Column:
    """What a retry is judged by: the thesis status in a thesis layer, the regime's signal elsewhere; unknown is neutral."""
    thesis = F.when(status.isin(*STANDING), "favor").otherwise("neutral")
    return F.when(layer.startswith("thesis"), thesis).otherwise(F.coalesce(signal, F.lit("neutral")))


def layered_retry_gate(orders: DataFrame) -> DataFrame:
    """The retry gate by side and layer over ``retry_count, side, layer, signal, status, priority``.

    Kill-switch and drawdown exits go to market at once. Below two expired attempts an order is tried again. From two on a
    favourable signal is tried again with a wider limit; an exit on a bearish one goes to market, as open exposure cannot wait;
    everything else, a buy on a bearish signal too, is skipped.
    """
    judged = retry_signal(F.col("layer"), F.col("signal"), F.col("status"))
    forced = F.coalesce((F.col("priority") <= FORCED_PRIORITY) & (F.col("side") == "sell"), F.lit(False))
    bearish = judged.isin("bear", "strong sell") & (F.col("side") == "sell")
    gate = L.case(
        (forced, "market"), (F.col("retry_count") < 2, "retry"), (bearish, "market"), (judged.isin("favor", "bull"), "retry"), default="skip"
    )
    tried = orders.select("*", judged.alias("judged_by"), gate.alias("gate"))
    return tried.select("*", F.when(F.col("gate") == "retry", (F.col("retry_count") + 1) * LIMITS["buffer"]).alias("widen_pct"))


def buying_power_scale(orders: DataFrame, account: str = "account_id") -> DataFrame:
    """All buys of an account scaled so their cost fits its cash."""
    total = orders.groupBy(account).agg(F.sum("cost").alias("_total"), F.max("cash").alias("_cash"))
    scale = F.least(F.lit(1.0), F.try_divide(F.greatest(F.lit(0.0), F.col("_cash")), F.col("_total")))
    return orders.join(total, account).select(*orders.columns, scale.alias("scale"), (F.col("cost") * scale).alias("scaled_cost"))


def drawdown_raise(positions: DataFrame, account: str, order: Sequence[str], pct: str, cash_pct: str) -> DataFrame:
    """Positions to close, lowest conviction first, until cash reaches its target."""
    scan = scanned(positions, [account], [F.col(c) for c in order], {"_raised": ("sum_before", F.col(pct))})
    raised = F.col("_raised") + F.col(cash_pct)
    return scan.select(*positions.columns, raised.alias("cash_before"), (raised < LIMITS["raise_cash_to"]).alias("close"))


def thesis_status(assumptions: DataFrame, key: str, as_of: str) -> DataFrame:
    """Next status of a thesis from its assumptions, trigger, kill switch and review date."""
    agg = assumptions.groupBy(key).agg(
        F.bool_and(F.col("status") == "INTACT").alias("all_intact"),
        F.bool_or(F.col("status") == "UNDER PRESSURE").alias("pressured"),
        F.bool_or("trigger_met").alias("triggered"),
        F.bool_or("kill").alias("killed"),
        F.max("review_date").alias("review_date"),
    )
    return agg.select(
        key,
        L.case(
            (F.col("killed"), "INVALIDATED"),
            (F.col("review_date") <= F.lit(as_of).cast("date"), "TIME EXPIRED"),
            (F.col("pressured"), "WEAKENING"),
            (F.col("triggered") & F.col("all_intact"), "STRENGTHENING"),
            default="ACTIVE",
        ).alias("next_status"),
    )


def with_streak(df: DataFrame, hit: str, keys: Sequence[str], time: str, out: str) -> DataFrame:
    """Add the length of the run of true values that ends at each row."""
    w = Window.partitionBy(*keys).orderBy(time)
    placed = df.select("*", F.row_number().over(w).alias("_row"))
    broken = F.max(F.when(~F.coalesce(F.col(hit), F.lit(False)), F.col("_row"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("*", (F.col("_row") - F.coalesce(broken, F.lit(0))).alias(out)).drop("_row")


def divergence_verdict(evals: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Kind of divergence per evaluation and the verdict from its streak and the audit."""
    family = F.col("blind_family") != F.col("official_family")
    score = ~family & (F.abs(F.col("blind_score") - F.col("official_score")) > 0.3)
    liquidity = F.col("blind_liquidity") != F.col("official_liquidity")
    clean = lambda c: F.coalesce(c, F.lit(False))
    marked = evals.select("*", clean(family).alias("family_divergence"), clean(score).alias("score_divergence"), clean(liquidity).alias("liquidity_divergence"))
    counted = with_streak(marked, "family_divergence", keys, time, "streak")
    challenge = (F.col("streak") >= 7) | ((F.col("streak") >= 5) & F.col("audit_failed"))
    return counted.select(
        "*", L.case((clean(challenge), "CHALLENGE"), (F.col("streak") > 0, "CAUTION"), default="AGREE").alias("verdict")
    )


def scanner_flags(signals: DataFrame, rules: list[tuple[str, str, str, float]], keys: Sequence[str], band: float = 10.0) -> DataFrame:
    """Rule table over latest signals: flagged and ambiguous near the threshold."""
    parts = []
    for name, column, op, threshold in rules:
        v = F.col(column)
        hit = v > threshold if op == ">" else v < threshold
        parts.append(
            F.struct(
                F.lit(name).alias("rule"),
                v.cast("double").alias("value"),
                F.coalesce(hit, F.lit(False)).alias("flagged"),
                F.coalesce(F.abs(v / threshold - 1) <= band / 100, F.lit(False)).alias("ambiguous"),
            )
        )
    return signals.select(*keys, F.inline(F.array(*parts)))


def capped_queue(candidates: DataFrame, key: str, ident: str, order: Sequence[Column], cap: int) -> DataFrame:
    """The best ``cap`` candidates of each key advance, the rest wait.

    The rank filter is pushed below the shuffle as a group limit, so a hot key ships ``cap`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = candidates.select(key, ident, rank.alias("rank")).where(F.col("rank") <= cap)
    return candidates.join(best, [key, ident], "left").select(
        *candidates.columns, F.coalesce("rank", F.lit(0)).alias("rank"), F.when(F.col("rank").isNotNull(), "advance").otherwise("deferred").alias("decision")
    )


def allocate_budget(orders: DataFrame, account: str, order: Sequence[str], structural: Column, block: int = BLOCK_ROWS) -> DataFrame:
    """Turnover budget in priority order: structural entries are reserved first, the rest share what is left."""
    place, pct = [F.col(c) for c in order], F.col("turnover_pct")

    def steps(rows: DataFrame, scan: Callable) -> DataFrame:
        first = scan(rows, place, {"_c": ("sum", F.when(structural, pct))})
        held = first.select(*orders.columns, (structural & (F.col("_c") <= LIMITS["structural_reserve"])).alias("reserved"))
        second = scan(held, place, {"_rest": ("sum", F.when(~F.col("reserved"), pct)), "_taken": ("total", F.when(F.col("reserved"), pct))})
        fits = F.coalesce("_taken", F.lit(0.0)) + F.col("_rest") <= LIMITS["turnover"]
        return second.select(*orders.columns, "reserved", F.when(F.col("reserved") | fits, "execute").otherwise("skip").alias("decision"))

    return by_size(orders, [account], steps, block, write=False)


def exposure_overlap(exposures: DataFrame, theses: DataFrame) -> DataFrame:
    """Per (account, thesis): share of exposure that overlaps its long tags and that opposes its reduce tags.

    Holdings are summed to (account, dimension, label) before the tag join, so the join sees labels, not holdings.
    """
    tagged = exposures.join(theses, (F.col("dim") == F.col("tag_dim")) & (F.col("label") == F.col("tag")))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("pct")).otherwise(0.0))
    return tagged.groupBy("account_id", "thesis_id").agg(side("long").alias("overlap_pct"), side("reduce").alias("opposing_pct"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per changed column between two versions of a keyed table."""
    a = old.select(*keys, F.struct(*cols).alias("_old"))
    z = new.select(*keys, F.struct(*cols).alias("_new"))
    changes = [
        F.when(
            ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")),
            F.struct(F.lit(c).alias("field"), F.col(f"_old.{c}").cast("string").alias("old"), F.col(f"_new.{c}").cast("string").alias("new")),
        )
        for c in cols
    ]
    return a.join(z, list(keys), "full_outer").select(*keys, F.inline(F.array_compact(F.array(*changes))))


def resolve_forecasts(forecasts: DataFrame, regimes: DataFrame) -> DataFrame:
    """Label realised at each forecast's target month."""
    real = regimes.select("entity_id", F.col("month").alias("target_month"), F.col("regime").alias("outcome"))
    due = forecasts.select("*", F.last_day(F.add_months("made_on", F.col("horizon"))).alias("target_month"))
    return due.join(real, ["entity_id", "target_month"])


def brier(resolved: DataFrame) -> DataFrame:
    """Brier scores of the adjusted and base-rate distributions per forecast; positive alpha means the adjustment helped."""
    actual = (F.col("target") == F.col("outcome")).cast("double")
    return resolved.groupBy("entity_id", "made_on", "horizon").agg(
        F.sum(F.pow(F.col("prob") - actual, 2)).alias("adjusted_brier"),
        F.sum(F.pow(F.col("base_rate") - actual, 2)).alias("base_brier"),
        F.avg(F.abs(F.col("prob") - F.col("base_rate"))).alias("adjustment"),
    ).select("*", (F.col("base_brier") - F.col("adjusted_brier")).alias("alpha"))


def forecast_alpha(scored: DataFrame, min_resolved: int = 20, alert_after: int = 8) -> DataFrame:
    """Cumulative alpha per entity once enough forecasts have resolved, with an alert on a run of negatives."""
    w = Window.partitionBy("entity_id", "horizon").orderBy(F.col("made_on").desc())
    placed = scored.select("*", F.row_number().over(w).alias("_pos"))
    agg = placed.groupBy("entity_id", "horizon").agg(
        F.count("*").alias("n_resolved"),
        F.avg("alpha").alias("_alpha"),
        F.avg("adjustment").alias("mean_adjustment"),
        (F.coalesce(F.min(F.when(F.col("alpha") >= 0, F.col("_pos"))), F.count("*") + 1) - 1).alias("negative_streak"),
    )
    enough = F.col("n_resolved") >= min_resolved
    return agg.select(
        "entity_id", "horizon", "n_resolved", F.when(enough, F.col("_alpha")).alias("mean_alpha"), "mean_adjustment", "negative_streak",
        (enough & (F.col("negative_streak") >= alert_after)).alias("alert"),
    )


def base_rates(current: DataFrame, eight: DataFrame, four: DataFrame, durations: DataFrame) -> DataFrame:
    """Row of the current label in the shrunk 8-label matrix, else in the 4-label one, with its mean duration."""
    e = eight.select("entity_id", "horizon", F.col("source").alias("regime_8"), "target", F.col("shrunk").alias("base_rate")).where(
        F.col("base_rate").isNotNull()
    )
    with8 = current.join(e, ["entity_id", "regime_8"]).select("entity_id", "regime_8", "horizon", "target", "base_rate", F.lit("eight").alias("matrix"))
    f = four.select("entity_id", "horizon", F.col("source").alias("regime"), "target", F.col("prob").alias("base_rate")).where(
        F.col("base_rate").isNotNull()
    )
    lacking = current.join(with8.select("entity_id").distinct(), "entity_id", "left_anti")
    with4 = lacking.join(f, ["entity_id", "regime"]).select("entity_id", "regime_8", "horizon", "target", "base_rate", F.lit("four").alias("matrix"))
    return with8.unionByName(with4).join(durations.select("entity_id", "regime_8", "mean_months"), ["entity_id", "regime_8"], "left")


def trailing_majority(votes: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], rows: int = 4) -> DataFrame:
    """Condition that flips only when most of the last ``rows`` period votes agree; a tie keeps the state."""
    loose = sum((F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    tight = sum((F.coalesce((F.col(c) == 0).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(time)
    frame = w.rowsBetween(-(rows - 1), 0)
    period = votes.select(*keys, time, L.case((loose > tight, "loose"), (tight > loose, "tight")).alias("vote"))
    counts = period.select(
        "*",
        F.count(F.when(F.col("vote") == "loose", 1)).over(frame).alias("_l"),
        F.count(F.when(F.col("vote") == "tight", 1)).over(frame).alias("_t"),
    )
    clear = L.case((F.col("_l") * 2 > rows, "loose"), (F.col("_t") * 2 > rows, "tight"))
    state = F.last(clear, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, time, "vote", state.alias("condition"))


def lead_time(evals: DataFrame, keys: Sequence[str], time: str, within: int = 4) -> DataFrame:
    """For each official change, periods since the first divergence after the previous change; and whether each
    divergence was followed by a change within ``within`` periods or fell into a transition."""
    w = Window.partitionBy(*keys).orderBy(time)
    placed = evals.select("*", F.row_number().over(w).alias("_row"), F.coalesce(F.col("official") != F.lag("official").over(w), F.lit(False)).alias("changed"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_change = F.coalesce(F.max(F.when(F.col("changed"), F.col("_row"))).over(before), F.lit(0))
    epochs = placed.select("*", last_change.alias("_epoch"))
    first = F.min(F.when(F.col("diverged"), F.col("_row"))).over(Window.partitionBy(*keys, "_epoch").orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.max("changed").over(w.rowsBetween(1, within))
    around = F.max("changed").over(w.rowsBetween(-within, within))
    return epochs.select(
        *keys,
        time,
        "changed",
        "diverged",
        F.when(F.col("changed"), (F.col("_row") - first).cast("double")).alias("lead"),
        F.when(F.col("diverged"), F.coalesce(ahead, F.lit(False))).otherwise(False).alias("hit"),
        F.when(F.col("diverged"), F.when(F.coalesce(around, F.lit(False)), "transition").otherwise("stable")).alias("context"),
    ).where("changed OR diverged")


def theme_persistence(mentions: DataFrame, keys: Sequence[str], week: str = "week_no", flag_at: int = 3) -> DataFrame:
    """Consecutive weeks per theme that end at its latest week; repeated mentions in a week count once."""
    weeks = mentions.groupBy(*keys, week).agg(F.count("*").alias("_n"))
    island = F.col(week) - F.row_number().over(Window.partitionBy(*keys).orderBy(week))
    runs = weeks.select(*keys, week, island.alias("_i")).groupBy(*keys, "_i").agg(F.count("*").alias("weeks"), F.max(week).alias("last_week"))
    return runs.groupBy(*keys).agg(F.max_by("weeks", "last_week").alias("weeks_running"), F.max("last_week").alias("last_week")).select(
        "*", (F.col("weeks_running") >= flag_at).alias("persistent")
    )


def theme_convergence(mentions: DataFrame, keys: Sequence[str], source: str, at_least: int = 3) -> DataFrame:
    """Themes held by several sources in the same week."""
    return mentions.groupBy(*keys).agg(F.countDistinct(source).alias("n_sources")).where(F.col("n_sources") >= at_least)


def scorecard(calls: DataFrame, category: str, time: str) -> DataFrame:
    """Verdict counts per category and period with the cumulative hit rate over all periods so far."""
    w = Window.partitionBy(category).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    per = calls.groupBy(category, time).agg(
        n("CORRECT").alias("correct"), n("PARTIAL").alias("partial"), n("WRONG").alias("wrong"), n("TOO EARLY").alias("too_early")
    )
    judged = F.sum(F.col("correct") + F.col("partial") + F.col("wrong")).over(w)
    return per.select("*", F.when(judged > 0, F.sum("correct").over(w) / judged * 100).alias("cumulative_rate"))
