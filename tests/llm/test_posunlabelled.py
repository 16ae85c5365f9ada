"""The positive-unlabelled classifier against plain recomputation, known priors and held-out documents."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import posunlabelled as pu, queries


def plain_features(text):
    raw = (text or "").encode()
    kind = lambda b: next((k for k, members in enumerate(pu.KINDS) if b in members), pu.SIDE - 2 if b < 128 else pu.SIDE - 1)
    kinds = [kind(b) for b in raw]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    out = [math.sqrt(pairs[a, b] / max(1, len(raw) - 1)) for a in range(pu.SIDE) for b in range(pu.SIDE)]
    words = [w for w in raw.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    n = len(words)
    if not n:
        return out + [0.0] * len(pu.COUNTS)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    return out + [
        math.log1p(n),
        math.log1p(len(raw)),
        math.log1p(sum(map(len, words)) / n),
        len(set(words)) / n,
        max(Counter(words).values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n - 1) if n > 1 else 0.0,
        1 - len(set(triples)) / len(triples) if triples else 0.0,
        sum(len(w) <= 3 for w in words) / n,
        sum(len(w) >= 12 for w in words) / n,
        math.log1p(raw.count(b"\n")) / math.log1p(n),
    ]


def plain_score(model, text):
    net, x = model.network, plain_features(text)
    x = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(x, net.mean, net.scale, strict=True)]
    hidden = [math.tanh(sum(v * w for v, w in zip(x, net.inner[:, j], strict=True)) + net.inner_bias[j]) for j in range(net.inner.shape[1])]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, net.outer, strict=True)) + net.outer_bias[0])))


@pytest.mark.parametrize("text", ["", "a", " \n\t ", "Ein Wort, noch ein Wort!\nein Wort", "ÄÖ 日本 \x00\x7f " * 30, "spam spam | spam ### 12-3 " * 40])
def test_features_equal_plain_ones(text, monkeypatch):
    monkeypatch.setattr(pu, "SLICE", 16)
    assert np.allclose(pu.features(text.encode()), plain_features(text))


def test_query_equals_plain_model(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = pu.fit(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in queries.BUILDERS["op12_quality"](spark, sf).collect():
        want = plain_score(model, texts.pop(r.doc_id))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert not texts


def test_long_text_is_described_whole():
    text = "alpha beta gamma " * 500_000
    x = pu.features((text + "!" * 1000).encode())
    assert x[pu.SIDE * pu.SIDE] == np.log1p(1_500_001) and not np.allclose(x, pu.features(text.encode()))


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_classes_of_two_clouds(prior):
    rng = np.random.default_rng(11)
    good, bad = (lambda n: rng.normal(size=(n, 6)) + 1.5), (lambda n: rng.normal(size=(n, 6)) - 1.5)
    n = 4000
    mixed = np.concatenate([good(int(n * prior)), bad(n - int(n * prior))])
    model = pu.learn(good(2000), mixed[rng.permutation(len(mixed))], steps=600)
    assert abs(model.prior - prior) < 0.07
    assert (model.score(good(500)) >= 0.5).mean() > 0.97 and (model.score(bad(500)) < 0.5).mean() > 0.95


def test_step_turns_back_below_zero():
    good, mixed = np.array([-3.0, -2.0]), np.array([-4.0, -5.0])
    up_good, up_mixed = pu.non_negative(0.9)(good, mixed)
    assert (up_mixed < 0).all() and (up_good > 0).all()
    down_good, down_mixed = pu.non_negative(0.9)(-good, -mixed)
    assert (down_mixed > 0).all() and (down_good < 0).all()
    # The slope is that of the unbiased risk, by differences.
    risk = lambda p, u: 0.4 * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - 0.4 * np.logaddexp(0, p).mean()
    p, u, e = np.array([0.3, -0.2]), np.array([1.0, 2.0]), 1e-6
    slope_p, slope_u = pu.non_negative(0.4)(p, u)
    assert abs((risk(p + [e, 0], u) - risk(p, u)) / e - slope_p[0]) < 1e-4 and abs((risk(p, u + [0, e]) - risk(p, u)) / e - slope_u[1]) < 1e-4


def test_finds_junk_among_held_out_texts(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    good = lambda: " ".join(word() for _ in range(60)) + ".\nThe " + word()
    bad = lambda: ("| ".join(word() + "##" for _ in range(50)) if rng.random() < 0.5 else (word().upper() + "!! ") * 40)
    rows = [(i, good() if i % 4 else bad()) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 1200) if i % 2], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pu.score(df, pu.fit(df, labels)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 > 0) for i in held]) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, 0.5, "x"), (1, None, 0.5, "x"), (2, "", 0.1, "y"), (None, "some words here", 0.2, "z"), (4, "w " * 50_000, 0.3, None), (7, "good words, in a row.", 0.9, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, _body string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (7, 1), (7, 1), (99, 1)], "doc_id long, quality int")
    model = pu.fit(df, labels)
    got = pu.score(df, model)
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 6 and all(0 <= r.score <= 1 for r in got.collect())
    assert {r._body for r in got.collect()} == {"x", "y", "z", None, "q"}
    none = pu.fit(df, labels.where("quality = 0"))
    assert {r.score for r in pu.score(df, none).collect()} == {0.5}
    assert pu.score(df.limit(0), pu.fit(df.limit(0), labels.limit(0))).count() == 0
