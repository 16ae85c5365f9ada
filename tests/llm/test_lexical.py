"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import lexical, words

DOCS = "doc_id long, text string, score long, rank int"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_words = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in set(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in rows:
            m = 25 + 75 * sum(c.values()) * n_docs // n_words
            one = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in wanted.items() if t in c)
            if one > 0:
                scores.append((-one, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def prose(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 300)


def cases():
    rng = np.random.default_rng(3)
    yield "odd", [(1, None), (2, ""), (3, "  ...  "), (None, "alpha beta"), (5, "Alpha, BETA! alpha"), (5, "Alpha, BETA! alpha"), (5, "beta"), (-7, "Ärger ärger ÄRGER alpha"), (8, "x" * 3000), (9, "日本 alpha\x00beta")], [
        (1, "alpha"), (1, "alpha"), (1, "beta beta"), (2, None), (3, ""), (None, "alpha"), (4, "unknown"), (5, "ÄRGER ärger 日本"), (6, "alpha alpha")
    ]
    docs = [(i, prose(rng, int(rng.integers(1, 80)))) for i in range(700)]
    items = [(i, prose(rng, 6)) for i in range(30)]
    yield "plain", docs, items
    # A third of all rows are copies, so many scores are equal and one stratum is hot.
    yield "copies", docs[:300] + [(1000 + i, "w1 w2 w7 w7 w9") for i in range(150)], [*items, (99, "w9 w7")]
    yield "long", [*docs[:50], (5000, prose(rng, 20000))], items
    yield "no documents", [], items
    yield "no items", docs[:20], []


@pytest.mark.parametrize(("name", "docs", "items"), list(cases()), ids=[c[0] for c in cases()])
def test_equals_scoring_all(spark, name, docs, items):
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    shards = lexical.index(df, shard_words=500, shard_docs=40)
    got = sorted(map(tuple, lexical.search(shards, asked, round_terms=40).collect()))
    assert got == brute(docs, items)


def test_strata_are_left_out_without_loss():
    """Short documents that have the word beat all long ones: only some strata are visited, and the best stay the best."""
    rng = np.random.default_rng(5)
    texts = [[0] * int(rng.integers(1, 3)) + [1 + int(x) for x in rng.integers(0, 30, int(rng.integers(1, 900)))] for _ in range(800)]
    numbers = {f"w{i}".encode(): i for i in range(31)}
    row = lexical._shard(0, list(range(800)), [np.array(t, np.int32) for t in texts], numbers)
    n_words = sum(map(len, texts))
    strata = lexical.Strata.of(type("Row", (), row), np.array([0, 5, -1]), 800, n_words)
    total = np.zeros(800, np.int64)
    ids, scores, visited = strata.search(np.array([0, 1, 2]), np.array([900, 1, 50]), 10, 0, total)

    def score(t):
        m = 25 + 75 * len(t) * 800 // n_words
        return sum(w * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x, w in ((0, 900), (5, 1)) if t.count(x))

    plain = sorted((-score(t), i) for i, t in enumerate(texts))[:10]
    assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == plain
    assert visited < strata.strata / 2 and not total.any()
    again, _, fewer = strata.search(np.array([0, 1, 2]), np.array([900, 1, 50]), 10, int(scores[-1]), total)
    assert again.tolist() == ids.tolist() and fewer <= visited


def test_slices_cut_between_words():
    raw = b"ab  cd efg " * 50 + b"x" * 100 + b" yz"
    parts = list(words.slices(raw, lexical.TERM_BYTES, 7))
    assert b"".join(parts) == raw and len(parts) > 30
    assert [w for p in parts for w in lexical.TERM_BYTES.findall(p)] == lexical.TERM_BYTES.findall(raw)
    assert words.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_shards_travel_alone(spark, monkeypatch):
    """Row groups and batches hold one shard each, however many a file has, and the session's settings are as before."""
    docs = [(i, prose(np.random.default_rng(i), 30)) for i in range(120)]
    shards = lexical.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), shard_docs=4)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in shards.inputFiles()]
    assert len(files) < 30 and sum(f.num_rows for f in files) == 30
    assert all(f.row_group(g).num_rows == 1 for f in files for g in range(f.num_row_groups))
    plain = lexical._visit

    def watched(*given):
        run = plain(*given)

        def alone(batches):
            for batch in batches:
                assert len(batch) <= 1
                yield batch

        return lambda batches: run(alone(batches))

    monkeypatch.setattr(lexical, "_visit", watched)
    key = next(iter(lexical.ONE_A_BATCH))
    before = spark.conf.get(key)
    items = [(i, prose(np.random.default_rng(1000 + i), 5)) for i in range(8)]
    got = lexical.search(shards, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs, items) and spark.conf.get(key) == before
