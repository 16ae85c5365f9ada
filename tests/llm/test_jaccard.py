"""The Jaccard join against comparing all pairs."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard as ja

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = SPLIT.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n, words=4000):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    while len(out) < n:
        size = rng.choice([1, 3, 5, 6, 7, 8, 9, 12, 15, 20, 30, 50, 90, 140, 300, 700])
        base = rng.choices(vocabulary, k=size)
        if rng.random() < 0.3 and size > 80:
            base[10:10] = passage
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(rng.choice(out[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(copy) // 40), max(1, len(copy) // 25)])):
                at, what = rng.randrange(len(copy) or 1), rng.random()
                copy[at : at + (what < 0.7)] = [rng.choice(vocabulary)] if what > 0.3 else []
            out.append(copy)
    return [(i, rng.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(out[:n])]


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int").repartition(parts)
    return sorted(map(tuple, ja.near_duplicates(df).collect()), key=str)


def test_sets_equal_brute_force():
    texts = ["", " \n", "One", "a b c d", "A b C d e", "x y z x y z x y z x y", "é Ü\x0bà 漢字 b\x85c d e f"]
    seen = {}
    for text, got in zip(texts, ja.shingle_sets(texts), strict=True):
        assert len(got) == len(brute_set(text))
    for text in (["a b c d e f", "A  B c\td e f"], ["a b", "ab"], ["a b c d", "a b c d e"]):
        one, two = ja.shingle_sets(text)
        seen[text[0], text[1]] = np.array_equal(one, two)
    assert list(seen.values()) == [True, False, False]


@pytest.mark.parametrize("n", [*range(1, 60), 100, 333, 1000, 20001])
def test_schemes_cover_every_pair(n):
    mine = {band: (m, apart, deletions) for band, m, apart, deletions in ja.schemes(n)}
    for other in range(n, ja.largest_partner(n) + 1):
        theirs = {band: (m, apart, deletions) for band, m, apart, deletions in ja.schemes(other)}
        both, far = mine.keys() & theirs.keys(), ja.most_apart(n, other)
        if far:
            assert any(mine[b][0] == theirs[b][0] and min(mine[b][1], theirs[b][1]) >= far and mine[b][0] > far for b in both)
    assert len({band & 1 for band in mine}) == len(mine)


@pytest.mark.parametrize("seed, pairs", [(1, ja.PAIRS), (2, 1)])
def test_equals_all_pairs(spark, seed, pairs, monkeypatch):
    monkeypatch.setattr(ja, "PAIRS", pairs)
    rows = corpus(seed, 500)
    assert run(spark, rows) == brute(rows)


def test_hot_group_copies_nulls_and_long_texts(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):  # near copies of one text, some too far from it
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 6, 7])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(60)]
    long = [f"l{i % 7000}-{i}" for i in range(20000)]
    rows += [(2000, " ".join(long)), (1999, " ".join(long[:19000])), (None, None), (3000, None), (3001, ""), (None, " ".join(base)), (3002, "a b c"), (3003, "a b c"), (3002, "other words are here now ok")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [], 1) == []


def test_linked_sets_meet_beyond_their_leader():
    rng, met, left = random.Random(4), 0, 0
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    array = lambda s: np.array(sorted(s), np.uint64)
    for _ in range(20000):
        base = rng.sample(range(40), rng.randrange(5, 25))
        one, two, head = [(set(base) - set(rng.sample(base, rng.randrange(0, 4)))) | set(rng.sample(range(40, 50), rng.randrange(0, 5))) for _ in range(3)]
        if linked(one, two) and not (linked(one, head) and linked(two, head)):
            small = min(len(one), len(two), len(head))
            (ties_one, in_one, a), (ties_two, in_two, b) = ja.beyond(array(one), array(head), small), ja.beyond(array(two), array(head), small)
            assert (ties_one, ties_two) == (linked(one, head), linked(two, head))
            enough = lambda shared: 7 * shared >= 3 * (len(one) + len(two))  # noqa: E731, B023
            loose = (not ties_one and enough(in_one) and len(two) < len(head)) or (not ties_two and enough(in_two) and len(one) < len(head))
            assert loose or set(a.tolist()) & set(b.tolist())
            met, left = met + 1, left + loose
    assert met > 200 and left < met


def test_far_copies_of_one_text(spark, monkeypatch):
    """Copies of one text that are too far apart to link, among them some that link, with lists thinned to the end."""
    monkeypatch.setattr(ja, "PAIRS", 1)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(40), 3):
            words[at] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_sketches_spare_every_link_and_most_pairs():
    rng, kept = random.Random(5), 0
    for _ in range(2000):
        base = [rng.getrandbits(64) for _ in range(rng.randrange(1, 300))]
        one, two = (set(rng.sample(base, rng.randrange(len(base) * 4 // 5, len(base)) + 1)) | {rng.getrandbits(64) for _ in range(rng.randrange(1 + len(base) // 8))} for _ in range(2))
        bits = sum(int(x).bit_count() for x in (ja.sketch(np.array(sorted(one), np.uint64)) ^ ja.sketch(np.array(sorted(two), np.uint64))).view(np.uint64))
        assert bits <= len(one ^ two)
        other = ja.sketch(np.array(sorted(rng.getrandbits(64) for _ in one), np.uint64)) ^ ja.sketch(np.array(sorted(one), np.uint64))
        kept += 7 * sum(int(x).bit_count() for x in other.view(np.uint64)) <= 2 * len(one)
    assert kept < 20


def test_candidates_of_long_lists_are_few(spark, monkeypatch):
    """Texts that share half of their words are listed together; none of their pairs but the linked ones may form."""
    monkeypatch.setattr(ja, "PAIRS", 1 << 30)
    found, plain = [], ja.list_pairs
    monkeypatch.setattr(ja, "list_pairs", lambda *x: found.append(plain(*x)) or found[-1])
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(60 + i % 5)])) for i in range(120)]
    rows += [(200 + i, rows[2 * i][1] + " end") for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert found and sum(df.count() for df in found) < 1000


def test_links_join_components_of_before(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    comps = spark.createDataFrame([], "class bigint, comp bigint")
    for at in range(0, 260, 65):
        comps = ja.merged(comps, spark.createDataFrame(edges[at : at + 65], "a bigint, b bigint"))
    got = dict(map(tuple, comps.collect()))
    least = list(range(300))
    for _ in range(300):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert len(got) == comps.count() and set(got) == linked
    assert all((got[a] == got[b]) == (least[a] == least[b]) for a in linked for b in linked)
