"""Collocations against counting every phrase."""

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import collocations as col


def brute(rows, least, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        inside = Counter()
        for p, v in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], v)
        scored = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def prose(rng, n, words=25):
    return "".join(f"W{int(x)}é" + str(rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "!?"])) for x in rng.zipf(1.4, n) % words)


def cases():
    rng = np.random.default_rng(2)
    langs = ["en", "de", None, "und"]
    plain = [(prose(rng, int(rng.integers(1, 60))), langs[int(rng.integers(0, 4))]) for _ in range(300)]
    yield "plain", plain
    # A third of all rows are copies, so one phrase is hot; and one text is longer than all others together.
    yield "hot", plain[:200] + [("the same four words again the same", "en")] * 100
    yield "long", [(prose(rng, 20000), "en"), *plain[:20]]
    yield "odd", [(None, "en"), ("", None), (" \t ", "en"), ("...", "de"), ("a b a b a b", None), ("a b a b a b", "und"), ("x" * 5000 + " y", "en"), ("A\x00 \x85b\x85 a\x00 \x85b\x85", "en"), ("  a b", "")] * 3
    yield "empty", []


@pytest.mark.parametrize(("name", "rows"), list(cases()), ids=[c[0] for c in cases()])
@pytest.mark.parametrize("budget", [40, 1 << 19])
def test_equals_counting_all(spark, name, rows, budget):
    df = spark.createDataFrame([(t, lang, 1, "x", 2) for t, lang in rows], "text string, lang string, rank int, phrase string, h1 int").repartition(3)
    got = sorted(map(tuple, col.collocations(df, least=4, top=30, budget=budget, block_words=300).collect()))
    assert got == brute(rows, 4, 30)


def test_equal_scores_are_cut_by_phrase(spark):
    rows = [(f"a{i:02d} b{i:02d}", "en") for i in range(40) for _ in range(5)]
    got = sorted(map(tuple, col.collocations(spark.createDataFrame(rows, "text string, lang string"), least=5, top=7).collect()))
    assert [r[2] for r in got] == [f"a{i:02d} b{i:02d}" for i in range(7)] and got == brute(rows, 5, 7)


def test_subtree_totals():
    frame = pd.DataFrame([(1, 2, 3, 4, 5, False), (1, 2, 3, 0, 2, False), (1, 2, 3, 9, 1, False), (1, 2, 8, 4, 1, False), (1, 2, 3, 4, 1, False), (7, 7, 7, 7, 1, True)], columns=[*col.WORDS, "f", "dealt"])
    nodes = set(map(tuple, col.subtree(frame, 3).itertuples(index=False)))
    assert nodes == {(1, 2, 3, 0, 9), (1, 2, 3, 4, 6), (7, 7, 7, 0, 1), (7, 7, 7, 7, 1)}


def test_bitmap_has_what_was_put_in(spark):
    h = [0, 1, -1, 2**62, -(2**63), 12345678901234567, (1 << 39) * 5]
    found = col.Bitmap(spark.createDataFrame([(x,) for x in h], "h long"), col._bit(col.F.col("h")))
    assert found.has(col._bits(np.array(h, np.int64))).all() and not found.has(col._bits(np.array([(1 << 39) * 77], np.int64))).any()
    pairs = col.Bitmap(spark.createDataFrame([(x, y) for x in h for y in h], "h1 long, h2 long"), col._bit(col.F.col("h1"), col.F.col("h2")))
    one, two = np.repeat(np.array(h, np.int64), len(h)), np.tile(np.array(h, np.int64), len(h))
    assert pairs.has(col._bits(one, two)).all()
