"""Top-k against comparing everything."""

import numpy as np
import pytest

from tidemark.llm import topk


def brute(rows, is_query, k):
    sound = {(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in {i for i, _ in sound if is_query(i)}:
        best = {}
        for i, v in sound:
            for j, w in sound:
                if i == q and j != q and len(v) == len(w):
                    s = sum(a * b for a, b in zip(v, w, strict=True))
                    best[j] = max(best.get(j, s), s)
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def cases():
    rng = np.random.default_rng(1)
    vec = lambda n=4: [float(x) for x in rng.normal(size=n).astype(np.float32)]
    one = vec()
    yield "odd", [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (10, [-1.0, 0.5]), (-5, [1.0, 2.0])]
    yield "plain", [(i, vec()) for i in range(300)]
    yield "copies", [(i, one if i % 3 else vec()) for i in range(300)]
    yield "few", [(0, vec()), (5, vec())]
    yield "empty", []
    yield "large", [(i, [float(x) * 1e6 for x in vec()]) for i in range(40)]


@pytest.mark.parametrize(("name", "rows"), list(cases()), ids=[n for n, _ in cases()])
def test_equals_brute_force(spark, name, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, topk.topk(df, lambda i: i % 5 == 0, k=6, shard_rows=64, block_rows=16).collect()))
    assert got == brute(rows, lambda i: i % 5 == 0, 6)


@pytest.mark.parametrize("copies", [False, True])
def test_tree_prunes_and_loses_nothing(copies):
    rng = np.random.default_rng(4)
    rows = rng.integers(-9, 9, (6, 8))[rng.integers(0, 6, 4000)] * 100 + (0 if copies else rng.integers(-20, 20, (4000, 8)))
    ids = rng.permutation(4000)
    tree = topk.BallTree.build(ids, rows, 32)
    for n in range(len(tree.radius)):
        part = tree.rows[tree.first[n] : tree.last[n]]
        assert (np.sqrt(((part - tree.centre[n]) ** 2).sum(1)) <= tree.radius[n]).all()
    queries = rows[:5] + 3
    scores = queries @ tree.rows.T
    for least in (topk.NEVER, np.sort(scores, 1)[:, -10]):
        q, i, s = tree.search(np.full(5, -1), queries, 10, np.broadcast_to(least, 5).copy())
        for a in range(5):
            order = np.lexsort((tree.ids, -scores[a]))[:10]
            assert sorted(zip(-s[q == a], i[q == a])) == sorted(zip(-scores[a][order], tree.ids[order]))


def test_an_id_with_many_vectors_takes_one_place(spark):
    """Ids 1 and 10 have 20 different vectors each, all better than those of other ids; 10 is a query as well."""
    rng = np.random.default_rng(8)
    vec = lambda far: [float(x) for x in (far + rng.normal(size=4)).astype(np.float32)]
    rows = [(i, vec(1)) for i in range(200)] + [(1, vec(9)) for _ in range(20)] + [(10, vec(7)) for _ in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.topk(df, lambda i: i % 5 == 0, k=6, shard_rows=64, block_rows=16).collect()))
    assert got == brute(rows, lambda i: i % 5 == 0, 6)


def test_best_of_counts_ids():
    query, ids, score = np.zeros(6, np.int64), np.array([1, 1, 1, 2, 3, 4]), np.array([9, 8, 7, 5, 6, 1])
    (_, kept, best), (_, kth) = topk.best_of(query, ids, score, 3)
    assert kept.tolist() == [1, 3, 2] and best.tolist() == [9, 6, 5] and kth.tolist() == [5]


def test_a_hot_id_is_dealt_over_shards(spark):
    rows = spark.createDataFrame([(1, [i, -i], 2) for i in range(512)], "id long, v array<bigint>, dim int")
    assert topk._packed(rows, "shard", 64, True).count() > 4
