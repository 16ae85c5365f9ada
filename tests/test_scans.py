"""Skew-safe scans against plain windows, with a third of all rows on one key."""

import hashlib

import numpy as np
from pyspark.sql import Window, functions as F

from tidemark.operators import align, analogs as an, decisions as dc, portfolio as pf, returns
from tidemark.operators.scans import by_size, framed, numbered, running, scanned, smaller_before
from tidemark.session import FREED, materialise


def skewed(spark, n=3000):
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    rows = [(str(k), int(i), int(t), None if rng.random() < 0.2 else float(round(v, 3))) for i, (k, t, v) in enumerate(zip(keys, rng.integers(0, 500, n), rng.normal(0, 5, n)))]
    return spark.createDataFrame(rows, "k STRING, id BIGINT, t BIGINT, v DOUBLE")


def test_running_equals_plain_windows(spark):
    df = skewed(spark)
    v = F.col("v")
    specs = {"s": ("sum", v), "c": ("count", v), "m": ("max", v), "f": ("first", v), "p": ("prev", v), "l": ("last", v)}
    got = running(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), specs)
    w = Window.partitionBy("k").orderBy("t", "id")
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "id", F.coalesce(F.sum("v").over(far), F.lit(0.0)).alias("ws"), F.count("v").over(far).alias("wc"), F.max("v").over(far).alias("wm"),
        F.first("v").over(far).alias("wf"), F.lag("v").over(w).alias("wp"), F.last("v", ignorenulls=True).over(far).alias("wl"),
    )
    both = got.join(want, "id")
    assert both.count() == df.count()
    assert both.where(F.abs(F.col("s") - F.col("ws")) > 1e-9).count() == 0
    for a, z in (("c", "wc"), ("m", "wm"), ("f", "wf"), ("p", "wp"), ("l", "wl")):
        assert both.where(~F.col(a).eqNullSafe(F.col(z))).count() == 0, a


def test_running_keeps_null_keys_and_times(spark):
    rows = [(k, t, i, float(i)) for i, (k, t) in enumerate([("a", 1), ("a", None), (None, 3), (None, None), ("a", 60), (None, 70), ("a", None)])]
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, id BIGINT, v DOUBLE")
    got = running(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), {"s": ("sum", F.col("v")), "p": ("prev", F.col("v"))})
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.sum("v").over(w).alias("s"), F.lag("v").over(w).alias("p"))
    assert sorted(map(tuple, got.select("id", "s", "p").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_scanned_equals_plain_windows_with_one_hot_time(spark):
    """A third of all rows on one key, half of them at one time: blocks are cut by row count."""
    df = skewed(spark).withColumn("t", F.when((F.col("k") == "hot") & (F.col("id") % 2 == 0), 7).otherwise(F.col("t")))
    df = df.withColumn("k", F.when(F.col("k") != "5", F.col("k")))
    v = F.col("v")
    kinds = ("sum", "max", "first", "prev", "last", "last_before", "next")
    got = scanned(df, ["k"], [F.col("t"), F.col("id")], {kind: (kind, v) for kind in kinds}, block=50)
    w = Window.partitionBy("k").orderBy("t", "id")
    far, past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        F.col("id").alias("i"), F.coalesce(F.sum("v").over(far), F.lit(0.0)).alias("w_sum"), F.max("v").over(far).alias("w_max"), F.first("v").over(far).alias("w_first"), F.lag("v").over(w).alias("w_prev"),
        F.last("v", True).over(far).alias("w_last"), F.last("v", True).over(past).alias("w_last_before"), F.first("v", True).over(ahead).alias("w_next"),
    )
    both = got.join(want, F.col("id") == F.col("i"))
    assert both.count() == df.count()
    assert both.where(F.abs(F.col("sum") - F.col("w_sum")) > 1e-9).count() == 0
    for kind in kinds[1:]:
        assert both.where(~F.col(kind).eqNullSafe(F.col(f"w_{kind}"))).count() == 0, kind


def test_framed_equals_plain_window(spark):
    df = skewed(spark)
    got = framed(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 50), 20, {"a": lambda w: F.avg("v").over(w)}, block=64)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-19, 0)
    both = got.join(df.select("id", F.avg("v").over(w).alias("b")), "id")
    assert both.count() == df.count()
    assert both.where((F.abs(F.col("a") - F.col("b")) > 1e-9) | (F.col("a").isNull() != F.col("b").isNull())).count() == 0


def test_fifo_against_a_queue(spark):
    rng = np.random.default_rng(11)
    trades = []
    for i in range(400):
        trades.append(("hot" if rng.random() < 0.4 else str(rng.integers(0, 5)), i, "buy" if rng.random() < 0.6 else "sell", float(rng.integers(1, 30)), float(rng.integers(50, 150))))
    import datetime as dt

    df = spark.createDataFrame([(k, i, s, q, p, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for k, i, s, q, p in trades], "k STRING, i BIGINT, side STRING, qty DOUBLE, price DOUBLE, date DATE")
    got = sorted((r.k, r.entry_price, r.exit_price, r.qty) for r in pf.match_fifo(df, ["k"], ["i"]).collect())
    want = []
    for key in {t[0] for t in trades}:
        buys = [[q, p] for k, _, s, q, p in trades if k == key and s == "buy"]
        for k, _, s, q, p in trades:
            if k != key or s != "sell":
                continue
            while q > 0 and buys:
                take = min(q, buys[0][0])
                want.append((key, buys[0][1], p, take))
                q -= take
                buys[0][0] -= take
                if buys[0][0] == 0:
                    buys.pop(0)
    assert got == sorted(want)


def test_top_k_blocks_are_exact(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 6))
    vectors[7] = 0.0
    rows = [("u" if i % 3 else "w", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "u STRING, id BIGINT, v ARRAY<DOUBLE>")
    q = df.select("u", F.col("id").alias("q_id"), F.col("v").alias("q_vec"), (F.col("id") - 5).alias("cutoff"))
    h = df.select("u", F.col("id").alias("h_id"), F.col("id").alias("h_ord"), F.col("v").alias("h_vec"))
    got = {}
    for r in an.top_k_similar(q, h, ["u"], k=4, block=16).orderBy("rank").collect():
        got.setdefault(r.q_id, []).append((r.h_id, round(r.sim, 9)))
    unit = vectors / np.where(np.linalg.norm(vectors, axis=1, keepdims=True) > 0, np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    for u, i, _ in rows:
        cand = [(j, round(float(unit[i] @ unit[j]), 9)) for w, j, _ in rows if w == u and j <= i - 5]
        want = sorted(cand, key=lambda c: (-c[1], c[0]))[:4]
        assert sorted(s for _, s in got.get(i, [])) == sorted(s for _, s in want)


def test_numbered_equals_row_number(spark):
    df = skewed(spark).withColumn("k", F.when(F.col("k") != "3", F.col("k")))
    got = numbered(df, ["k"], ["t", "id"], "n")
    want = df.select("id", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).alias("w"))
    assert got.join(want, "id").where("n = w").count() == df.count() == got.count()


def test_smaller_before_counts():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 7, 64, 300):
        v = rng.integers(0, 40, n)
        assert smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]


def test_expanding_rank_of_a_hot_key_equals_the_array_form(spark):
    df = skewed(spark, 4000).select("k", "t", "id", F.round("v", 1).alias("v"))
    got = align.expanding_rank(df, ["k"], ["t", "id"], "v", "r", block=64)
    plain = df.withColumn("o", F.struct("t", "id"))
    plain = plain.select("id", align.expanding_rank_pct(F.col("v"), ["k"], "o").alias("w")).where("w IS NOT NULL")
    both = got.join(plain, "id")
    assert both.count() == plain.count() == got.count() == df.where("v IS NOT NULL").count()
    assert both.where(F.abs(F.col("r") - F.col("w")) > 1e-12).count() == 0


def test_block_resamples_are_differences_of_prefix_sums():
    rng = np.random.default_rng(3)
    for n, block in ((5, 1), (17, 3), (40, 6), (4, 6)):
        v = rng.normal(size=n)
        got = returns.resampled_means(v, block, 50, 42)
        for b in range(1, 51):
            drawn = []
            for blk in range(-(-n // block)):
                bits = int(hashlib.md5(f"42|{b}|{blk}".encode()).hexdigest()[:7], 16)
                start = (bits * max(1, n - block + 1)) >> 28
                drawn += v[start : start + min(block, n - blk * block)].tolist()
            assert len(drawn) == n and abs(np.mean(drawn) - got[b - 1]) < 1e-12


def test_bootstraps_shuffle_no_replicates(spark):
    hits = spark.range(60).select((F.col("id") % 3).cast("string").alias("k"), "id", (F.col("id") % 2).cast("int").alias("hit"))
    text = an.bootstrap_proportion(hits, ["k"], ["id"], 200)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "MapInArrow" in text
    cells = spark.range(400).select(F.lit("e").alias("entity_id"), F.lit("a").alias("asset_id"), F.lit(3).alias("window"), F.col("id").alias("month"), (F.col("id") % 11).cast("double").alias("ret"), F.lit("x").alias("label"))
    base = returns.benchmarks(cells)
    boot = returns.bootstrap_mean(cells, "label", base, replicates=100)
    assert "Generate" not in boot._jdf.queryExecution().executedPlan().toString()
    row = boot.first()
    assert row.ci_low < row.mean < row.ci_high and not row.significant and row.n == 400


def test_proportion_is_the_same_under_every_partitioning(spark, monkeypatch):
    hits = spark.range(300).select((F.col("id") % 7).cast("int").alias("k"), "id", (F.col("id") % 3 == 0).cast("int").alias("hit"))
    one = sorted(map(tuple, an.bootstrap_proportion(hits.coalesce(1), ["k"], ["id"], 64).collect()))
    assert one == sorted(map(tuple, an.bootstrap_proportion(hits.repartition(5), ["k"], ["id"], 64).collect())) and len(one) == 7


def test_lists_are_left_out_exactly(spark):
    """Tight clusters, copies, a row of zeros and cutoffs: most lists are never met, and the best rows are those of a full search."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8))
    v = centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 8)) * 0.02
    v[5] = 0.0
    v[600:700] = v[600]
    df = spark.createDataFrame([("u", i, [float(x) for x in row]) for i, row in enumerate(v)], "u STRING, id BIGINT, v ARRAY<DOUBLE>")
    q = df.where("id % 3 = 2").select("u", F.col("id").alias("q_id"), F.col("v").alias("q_vec"), (F.col("id") - 1).alias("cutoff"))
    h = df.select("u", F.col("id").alias("h_id"), F.col("id").alias("h_ord"), F.col("v").alias("h_vec"))
    report = {}
    got = {}
    for r in an.top_k_similar(q, h, ["u"], k=5, block=16, report=report).orderBy("rank").collect():
        got.setdefault(r.q_id, []).append((round(r.sim, 9), r.h_id))
    u = an.unit(v)
    for i in range(2, 900, 3):
        sims = u[:i] @ u[i]
        want = sorted(sims, reverse=True)[:5]
        assert np.allclose([s for s, _ in got[i]], want, atol=1e-8) and all(j < i for _, j in got[i])
    assert report["visited"] < report["pairs"] / 2, report


def test_a_query_is_copied_per_pack_and_not_per_list(spark, monkeypatch):
    """Vectors of no order, where no list can be left out, and equal ones: exact rows, ties to the earlier, few rows written."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(600, 16))
    v[100:140] = v[100]
    df = spark.createDataFrame([("u", i, [float(x) for x in row]) for i, row in enumerate(v)], "u STRING, id BIGINT, v ARRAY<DOUBLE>")
    q = df.select("u", F.col("id").alias("q_id"), F.col("v").alias("q_vec"), (F.col("id") - 1).alias("cutoff"))
    h = df.select("u", F.col("id").alias("h_id"), F.col("id").alias("h_ord"), F.col("v").alias("h_vec"))
    written, write = {}, an.materialise
    monkeypatch.setattr(an, "materialise", lambda frame, label: written.setdefault(label, write(frame, label)))
    got = {}
    for r in an.top_k_similar(q, h, ["u"], k=5, block=8).orderBy("rank").collect():
        got.setdefault(r.q_id, []).append((round(r.sim, 9), r.h_id))
    u = an.unit(v)
    for i in range(1, 600):
        want = sorted(((-round(float(s), 9), j) for j, s in enumerate(u[:i] @ u[i])))[:5]
        assert [(-s, j) for s, j in got[i]] == want
    assert written["list-stats"].count() > 15
    met = [written[label] for label in ("first-visits", "later-visits")]
    assert sum(m.count() for m in met) <= 2 * 600 * (an.PACKS + 1) and all("q_vec" not in m.columns for m in met)


def test_next_value_does_not_go_over_the_rest_of_a_block_for_each_row(spark):
    df = spark.range(20).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    out = scanned(df, ["k"], [F.col("id")], {"n": ("next", F.col("v"))}, block=8)
    assert [r.n for r in out.orderBy("id").collect()] == [3] * 4 + [10] * 7 + [17] * 7 + [None] * 2
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_large_and_small_keys_by_their_own_ways(spark):
    """Keys beyond a block go by blocks, also in a second scan by another order; null keys and null places are among them."""
    df = skewed(spark).withColumn("k", F.when(F.col("k") != "hot", F.col("k"))).withColumn("t", F.when(F.col("id") % 11 > 0, F.col("t")))
    v = F.col("v")

    def steps(rows, scan):
        once = scan(rows, [F.col("t"), F.col("id")], {"s": ("sum_before", v), "p": ("prev", v)})
        return scan(once, [F.round("s", 3), F.col("id")], {"n": ("next", F.when(F.col("id") % 5 == 0, F.col("id"))), "a": ("total", F.col("id")), "f": ("first", F.col("id"))})

    want = [(r.id, None if r.s is None else round(r.s, 6), r.p, r.n, r.a, r.f) for r in by_size(df, ["k"], steps).orderBy("id").collect()]
    for block in (60, 200):
        got = [(r.id, None if r.s is None else round(r.s, 6), r.p, r.n, r.a, r.f) for r in by_size(df, ["k"], steps, block=block).orderBy("id").collect()]
        assert got == want
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("s"), F.lag("v").over(w).alias("p"), F.sum("id").over(Window.partitionBy("k")).alias("a"))
    assert [(r.id, round(r.s or 0.0, 6), r.p, r.a) for r in plain.orderBy("id").collect()] == [(i, s, p, a) for i, s, p, _, a, _ in want]


def test_scans_of_fitting_keys_share_one_exchange(spark):
    """two scans by the same keys shuffle and write the rows once, and nothing shuffled for a write stays behind."""
    import datetime as dt

    rng = np.random.default_rng(4)
    rows = [(str(i % 7), i, "buy" if rng.random() < 0.6 else "sell", float(rng.integers(1, 30)), 50.0 + i % 9, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, side STRING, qty DOUBLE, price DOUBLE, date DATE")
    out = pf.match_fifo(df, ["k"], ["i"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    some = [tuple(r) for r in pf.match_fifo(df, ["k"], ["i"], block=30).collect()]
    assert sorted(map(tuple, out.collect())) == sorted(some)
    halves = [F.pmod(F.xxhash64("i"), F.lit(2)) == i for i in range(2)]
    assert sorted(map(tuple, pf.match_fifo(df, ["k"], ["i"], slices=halves).collect())) == sorted(some)
    key = next(iter(FREED))
    before = spark.conf.get(key)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    materialise(df.groupBy("k").count(), "freed", FREED)
    assert tracker.shuffleStatuses().size() <= held and spark.conf.get(key) == before


def test_budget_by_blocks_equals_budget_by_windows(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if rng.random() < 0.6 else str(i % 4), f"s{i}", int(rng.integers(1, 50)), "structural" if rng.random() < 0.3 else None if rng.random() < 0.1 else "regime", float(rng.integers(1, 40)) / 16) for i in range(300)]
    df = spark.createDataFrame(rows, "account_id STRING, symbol STRING, size INT, layer STRING, turnover_pct DOUBLE")
    both = [sorted(map(tuple, dc.allocate_budget(df, "account_id", ["size", "symbol"], F.col("layer") == "structural", block=b).collect()), key=str) for b in (25, 1000)]
    assert both[0] == both[1] and len(both[0]) == 300 and {r[-1] for r in both[0]} == {"execute", "skip"}
