"""Hand-computed cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, labels as L
from tidemark.operators import align, analogs as an, decisions as dc, portfolio as pf, regime, returns as rt, signals as sg, transitions as tr


def months(n, start_year=2000):
    out = []
    for i in range(n):
        year, month = start_year + i // 12, i % 12 + 1
        nxt = dt.date(year + (month == 12), month % 12 + 1, 1)
        out.append(nxt - dt.timedelta(days=1))
    return out


def labelled(spark, seq, entity="A"):
    rows = [(entity, d, x) for d, x in zip(months(len(seq)), seq)]
    return spark.createDataFrame(rows, "entity_id STRING, month DATE, regime STRING")


def confirmed(spark, seq, **kwargs):
    df = labelled(spark, seq)
    out = regime.confirmation_filter(df, ["entity_id"], "month", "regime", "c", **kwargs)
    return [r.c for r in out.orderBy("month").collect()]


def fold(seq, k=2, initial=None):
    """The filter as a plain loop, written independently of the operator."""
    now, pending, n, out = initial, None, 0, []
    for raw in seq:
        if now is None:
            now, pending, n = raw, None, 0
        elif raw == now:
            pending, n = None, 0
        elif raw == pending:
            n += 1
            if n >= k:
                now, pending, n = raw, None, 0
        else:
            pending, n = raw, 1
        out.append(now)
    return out


@pytest.mark.parametrize(
    "seq,kwargs,expected",
    [
        ("GGGGGSGGGG", {}, "GGGGGGGGGG"),
        ("GGGGGSSSSS", {}, "GGGGGGSSSS"),
        ("GGG", {"initial": "S"}, "SGG"),
        ("GSGSGSGSGS", {}, "GGGGGGGGGG"),
    ],
)
def test_confirmation_golden(spark, seq, kwargs, expected):
    assert "".join(confirmed(spark, list(seq), **kwargs)) == expected


def test_confirmation_matches_loop_with_nulls(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for e in range(60):
        seq = [[None, "G", "S", "O"][i] for i in rng.integers(0, 4, 30)]
        rows += [(str(e), d, x) for d, x in zip(months(30), seq)]
        want[str(e)] = {k: fold(seq, k) for k in (1, 2, 3)}
    df = spark.createDataFrame(rows, "entity_id STRING, month DATE, regime STRING")
    for k in (1, 2, 3):
        got = {}
        for r in regime.confirmation_filter(df, ["entity_id"], "month", "regime", "c", k).orderBy("month").collect():
            got.setdefault(r.entity_id, []).append(r.c)
        assert got == {e: w[k] for e, w in want.items()}


def test_anchor_form_equals_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(str(e), d, "GSO"[i]) for e in range(40) for d, i in zip(months(40), rng.integers(0, 3, 40))]
    df = spark.createDataFrame(rows, "entity_id STRING, month DATE, regime STRING")
    both = regime.confirmation_filter(df, ["entity_id"], "month", "regime", "a").select(
        "*", regime.confirmation_anchors(F.col("regime"), ["entity_id"], "month").alias("b")
    )
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_direction_of_zero_is_falling(spark):
    row = spark.range(1).select(
        L.axis_direction(F.lit(0.0)).alias("zero"), L.axis_direction(F.lit(0.1)).alias("up"), L.axis_direction(F.lit(None).cast("double")).alias("none")
    ).first()
    assert (row.zero, row.up, row.none) == ("falling", "rising", None)


def test_transitions_golden(spark):
    df = labelled(spark, ["Goldilocks"] * 12 + ["Stagflation"] * 12)
    out = tr.transition_counts(df, ["entity_id"], "month", "regime", L.FAMILIES, (6,)).collect()
    cell = {(r.source, r.target): r for r in out}
    assert len(out) == 16
    assert cell["Goldilocks", "Goldilocks"].n == 6 and cell["Goldilocks", "Stagflation"].n == 6
    assert cell["Goldilocks", "Goldilocks"].n_source == 12 and cell["Goldilocks", "Stagflation"].prob == 0.5
    assert cell["Stagflation", "Stagflation"].n == 6 and cell["Stagflation", "Stagflation"].n_source == 6
    assert cell["Overheating", "Goldilocks"].prob is None and cell["Overheating", "Goldilocks"].low_n


def shrunk_cell(spark, n, p):
    eight = spark.createDataFrame(
        [("A", 6, L.LABELS_8[0], t, int(n * (p if i == 0 else (1 - p) if i == 1 else 0)), n, p if i == 0 else (1 - p) if i == 1 else 0.0) for i, t in enumerate(L.LABELS_8)],
        "entity_id STRING, horizon INT, source STRING, target STRING, n BIGINT, n_source BIGINT, prob DOUBLE",
    )
    four = spark.createDataFrame([("A", 6, "Goldilocks", t, 0.25) for t in L.FAMILIES], "entity_id STRING, horizon INT, source STRING, target STRING, prob DOUBLE")
    rows = tr.shrink(eight, four, ["entity_id"]).collect()
    assert abs(sum(r.shrunk for r in rows) - 1) < 1e-9
    return next(r.shrunk for r in rows if r.target == L.LABELS_8[0])


def test_shrinkage_bounds(spark):
    assert shrunk_cell(spark, 100, 0.8) > 0.7
    assert shrunk_cell(spark, 3, 1.0) < 0.5


def test_frequency(spark):
    df = labelled(spark, ["Goldilocks"] * 60 + ["Stagflation"] * 40)
    got = {r.regime: r.pct for r in tr.frequency(df, ["entity_id"], "regime").collect()}
    assert got == {"Goldilocks": 60.0, "Stagflation": 40.0}


@pytest.mark.parametrize("ps,want", [([0.01, 0.04, 0.08, 0.15], [True, True, False, False]), ([0.05], [True]), ([0.15], [False])])
def test_benjamini_hochberg(spark, ps, want):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "fam INT, i INT, p DOUBLE")
    out = rt.benjamini_hochberg(df, "p", ["fam"]).orderBy("i").collect()
    assert [r.bh_significant for r in out] == want


def test_bootstrap_guards_and_interval(spark):
    rng = np.random.default_rng(1)
    rows = [("A", "a", 1, m, "G", float(v)) for m, v in zip(months(60), rng.normal(1.5, 5, 60))]
    rows += [("A", "flat", 1, m, "G", 2.0) for m in months(20)] + [("A", "few", 1, m, "G", float(i)) for i, m in enumerate(months(3))]
    df = spark.createDataFrame(rows, "entity_id STRING, asset_id STRING, window INT, month DATE, regime STRING, ret DOUBLE")
    out = rt.bootstrap_mean(df, "regime", rt.benchmarks(df)).collect()
    assert [r.asset_id for r in out] == ["a"]
    values = np.array([r[5] for r in rows if r[1] == "a"])
    se = values.std() / np.sqrt(60)
    assert abs(out[0].ci_low - (values.mean() - 1.645 * se)) < 0.35 * se
    assert abs(out[0].ci_high - (values.mean() + 1.645 * se)) < 0.35 * se


def test_bootstrap_proportion_interval(spark):
    df = spark.range(400).select(F.lit("A").alias("k"), "id", (F.col("id") % 5 < 3).cast("int").alias("hit"))
    r = an.bootstrap_proportion(df, ["k"], ["id"], 800).first()
    half = 1.96 * np.sqrt(0.6 * 0.4 / 400) * 100
    assert r.hit_rate == 60.0 and abs(r.ci_low - (60 - half)) < 1.2 and abs(r.ci_high - (60 + half)) < 1.2


def test_unconditional_needs_two_values(spark):
    df = spark.createDataFrame([("A", "x", 1, None), ("A", "y", 1, 1.0), ("A", "z", 1, 1.0), ("A", "z", 1, 3.0)], "entity_id STRING, asset_id STRING, window INT, ret DOUBLE")
    assert [(r.asset_id, r.mean) for r in rt.benchmarks(df).collect()] == [("z", 2.0)]


def test_pct_change_is_positional_on_gappy_months(spark):
    days = [d for i, d in enumerate(months(16)) if i != 5]
    df = spark.createDataFrame([("A", "INDPRO", d, float(i + 1)) for i, d in enumerate(days)], "entity_id STRING, series_id STRING, month DATE, value DOUBLE")
    out = align.to_indicators(df).orderBy("month").collect()
    assert out[11].value is None and out[12].value == pytest.approx((13 / 1 - 1) * 100)


def test_spine_is_first_available_indicator(spark):
    rows = [("A", d, "unrate", 1.0) for d in months(4)] + [("A", d, "nfci", 2.0) for d in months(6)]
    df = spark.createDataFrame(rows, "entity_id STRING, month DATE, indicator STRING, value DOUBLE")
    assert align.align_on_spine(df, require=None).count() == 4


def test_forward_return_lag(spark):
    df = spark.createDataFrame([("a", d, 100.0 + i) for i, d in enumerate(months(24))], "asset_id STRING, month DATE, close DOUBLE")
    plain = align.forward_return(df, (3,)).orderBy("month").collect()
    lagged = align.forward_return(df, (3,), execution_lag=1).orderBy("month").collect()
    assert plain[0].ret == pytest.approx(3.0) and lagged[0].ret == pytest.approx((104 / 101 - 1) * 100)
    assert plain[21].ret is None and lagged[20].ret is None and lagged[19].ret is not None


def test_asof_nearest_tie_takes_later(spark):
    d = dt.date
    left = spark.createDataFrame([("k", d(2020, 1, 10)), ("k", d(2020, 3, 1))], "k STRING, t DATE")
    right = spark.createDataFrame([("k", d(2020, 1, 8), 1.0), ("k", d(2020, 1, 12), 2.0)], "k STRING, at DATE, v DOUBLE")
    got = {r.t: r.v for r in align.asof_nearest(left, right, ["k"], "t", "at", ["v"], 5).collect()}
    assert got == {d(2020, 1, 10): 2.0, d(2020, 3, 1): None}


def test_iso_week_uses_iso_year(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2018, 12, 31),)], "d DATE")
    assert [r.w for r in df.select(dates.iso_week(F.col("d")).alias("w")).collect()] == ["2020-W53", "2019-W01"]


def test_merge_moments_equals_all_at_once(spark):
    df = spark.range(50).select(F.lit("A").alias("k"), "id", (F.col("id") * F.col("id") % 17).cast("double").alias("value"))
    merged = sg.merge_moments(sg.moments(df.where("id < 20"), ["k"]), sg.moments(df.where("id >= 20"), ["k"]), ["k"]).first()
    whole = sg.moments(df, ["k"]).first()
    assert merged.n == whole.n and merged.mean == pytest.approx(whole.mean) and merged.m2 == pytest.approx(whole.m2)


def test_win_rates_zero_is_a_loss(spark):
    df = spark.createDataFrame([("regime", "m", 10.0), ("regime", "m", 0.0), ("regime", "m", -5.0), ("x", "m", None)], "layer STRING, mechanism STRING, realized_pl DOUBLE")
    r = next(r for r in pf.win_rates(df).collect() if r.scope == "all")
    assert (r.closed, r.wins, r.losses) == (3, 1, 2) and r.profit_factor == pytest.approx(10 / 2.5)


def test_fx_resolution_order(spark):
    df = spark.createDataFrame([("EUR", "BASE", 7.0), ("BASE", "EUR", 0.5), ("BASE", "JPY", 20.0), ("GBP", "USD", 1.3), ("USD", "BASE", 6.0)], "src STRING, dst STRING, rate DOUBLE")
    got = {r.currency: r.rate for r in pf.resolve_rates(df, "BASE").collect()}
    assert got["EUR"] == 7.0 and got["JPY"] == 0.05 and got["GBP"] == pytest.approx(7.8) and got["BASE"] == 1.0


def test_risk_reward_by_hand(spark):
    values = [-2.0, -1.0, 0.5, 1.0, 3.0, 8.0]
    df = spark.createDataFrame([("k", v) for v in values], "k STRING, ret DOUBLE")
    r = an.risk_reward(df, ["k"]).first()
    lo, hi = np.percentile(values, [10, 90])
    w = np.clip(values, lo, hi)
    assert r.ratio == pytest.approx(min(10, w[w > 0].mean() / abs(w[w < 0].mean())))
    assert r.hit_rate == pytest.approx(400 / 6) and r.std == pytest.approx(np.std(values)) and r.confidence == "low"
    assert an.risk_reward(df.limit(2), ["k"]).first().signal == "insufficient_data"


def test_tilted_template_totals(spark):
    df = spark.createDataFrame([(f, s) for f in L.FAMILIES for s in ("loose", "tight", None)], "regime STRING, liquidity_binary STRING").withColumn("entity_id", F.concat_ws("/", "regime", "liquidity_binary"))
    out = dc.tilted_template(dc.template_rows(df), ["entity_id"])
    assert all(abs(r.s - 95) < 1e-9 for r in out.groupBy("entity_id").agg(F.sum("target_pct").alias("s")).collect())
    assert out.where("weight = 0 AND target_pct > 0").count() == 0


def test_overlay_and_position_limits(spark):
    df = spark.createDataFrame([("a", "X", "Tech", "t1", 40.0), ("a", "Y", "Tech", "", 30.0), ("a", "Z", "Energy", "", 30.0)], "account_id STRING, symbol STRING, sector STRING, thesis STRING, target_pct DOUBLE")
    out = {r.symbol: r for r in dc.apply_limits(df).collect()}
    assert all(r.limited_pct <= 15 + 1e-9 for r in out.values()) and "position" in out["X"].corrections
    assert "sector" in out["Y"].corrections
