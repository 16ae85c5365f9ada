"""The network against plain loops and numeric slopes, accuracy on held-out rows, odd tables."""

import zlib

import numpy as np
import pytest

from tidemark.llm import langid


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 509, 510, 3000])
def test_windows_cover_every_ngram(size):
    text = "".join(chr(97 + i * 7 % 26) for i in range(size))
    raw, of, n = langid.windows(["", text, "é"])
    assert set(of.tolist()) == ({1, 2} if size else {2})
    mine = [bytes(r[:k]) for r, o, k in zip(raw, of, n, strict=True) if o == 1]
    grams = {w[i : i + 4] for w in mine for i in range(len(w) - 3)}
    assert grams == {text.encode()[i : i + 4] for i in range(size - 3)}


def test_forward_equals_loops_and_gradient_step_lowers_loss():
    net = langid.Network.fresh(["a", "b"])
    raw = langid.windows(["some text for the filters " * 4, "x"])[0]
    seen = net.responses(raw)
    for row, at, f in ((0, 3, 0), (1, 0, 9), (0, 40, 31)):
        assert seen[row, at, f] == pytest.approx(sum(float(net.tables[k][raw[row, at + k], f]) for k in range(langid.WIDEST)), rel=1e-5)
    trained = langid.train(raw, np.array([0, 1]), ["a", "b"], rounds=30)
    assert trained.probabilities(raw).argmax(1).tolist() == [0, 1]
    assert (trained.tables[2:, :, :8] == 0).all()


def rows(n=600):
    rng = np.random.default_rng(2)
    syllables = {"aa": ["the", "ing", "sh", "er"], "bb": ["ci", "ón", "ar", "que"], "cc": ["sch", "ung", "ü", "ei"]}
    out = []
    for i in range(n):
        name = list(syllables)[i % 3]
        words = ["".join(rng.choice(syllables[name], rng.integers(1, 4))) for _ in range(rng.integers(3, 120))]
        out.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words), name))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows()
    odd = [(10001, None, "aa"), (10002, "", "bb"), (10003, "12 34 !?", "cc"), (10004, "the shing " * 30000, None), (None, "schung eiung", "cc"), (3, "again the shing", "aa")]
    df = spark.createDataFrame([(*r, 1.0) for r in data + odd], "doc_id long, text string, lang string, score double").repartition(3)
    net = langid.fit(df)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, net).collect()]
    assert len(got) == len(data) + len(odd) and all(0 <= s <= 1 for _, _, s in got)
    by = {k: (name, s) for k, name, s in got if k not in (None, 3)}
    assert all(by[k] == ("und", 0.0) for k in (10001, 10002, 10003)) and by[10004][0] == "aa"
    held = [(k, name) for k, _, name in data if k != 3 and zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([by[k][0] == name for k, name in held]) > 0.97
    again = langid.fit(df.repartition(5))
    assert np.allclose(again.tables, net.tables)


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(df, langid.fit(df)).collect()] == [(1, "und", 0.0)]
    assert langid.predict(df.limit(0), langid.fit(df.limit(0))).count() == 0
