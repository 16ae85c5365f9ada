"""Toxicity: keys against plain Python, counts against brute force, held-out accuracy, odd tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as tx


def words(text):
    out, word = [], b""
    for byte in text.lower().encode() + b" ":
        if tx.LETTER[byte]:
            word += bytes([byte])
        elif word:
            out.append(word)
            word = b""
    return out


@pytest.mark.parametrize("texts", [[""], ["Abc, ABC d1e", "", " é漢字!", "abc"], ["x" * 3000, "..", "a b"]])
def test_keys_name_prefixes(texts):
    keys, ends, n = tx.grams(texts)
    assert n.tolist() == [len(words(t)) for t in texts]
    seen = {}
    for i, text in enumerate(texts):
        want = [(w[:j], w[j] if j < len(w) else 0) for w in words(text) for j in range(len(w) + 1)]
        own = keys[ends[i] : ends[i + 1]].tolist()
        assert len(own) == len(want)
        for key, name in zip(own, want, strict=True):
            assert seen.setdefault(key, name) == name and key & 255 == name[1]
    assert len(set(seen.values())) == len(seen)


def corpus(n=1200):
    rng = np.random.default_rng(5)
    common = ["".join(rng.choice(list("abdeginorst"), rng.integers(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(common, rng.integers(30, 200))]
        toxic = i % 5 == 1
        if toxic:
            for k in rng.choice(len(text), max(2, len(text) // 25), replace=False):
                text[k] = "grumf" + str(rng.choice(common))
        docs.append((i, " ".join(text), "clash"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_unseen_suffixes(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(df, lab)
    got = {r.doc_id: r.score_ for r in tx.score(df, model).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == t for i, t in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert model.score(["so grumfly a grumfish"])[0] > model.score(["so early a starfish"])[0]
    assert model.score([""])[0] < 0.5


def test_counts_cover_every_row(spark):
    rows = [("ab ab", 0), ("AB c", 1), ("", 2), ("ab " * 1000, 3), ("b", 3)]
    got = {r.gram: (r.c0, r.c1, r.c2, r.c3) for r in tx.gram_counts(spark.createDataFrame(rows, "text string, part int").repartition(3)).collect()}
    want = {}
    for text, part in rows:
        for key, n in Counter(tx.grams([text])[0].tolist()).items():
            want.setdefault(key, [0] * 4)[part] += n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_nulls_ties_and_empty_tables(spark):
    docs, labels = corpus(300)
    rows = [*docs, (None, None, None), (7, "twice", None), (7, "twice", None)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (3, None), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    assert tx.score(df, tx.fit(df, lab)).count() == len(rows)
    for model in (tx.fit(df, lab.limit(0)), tx.fit(df.limit(0), lab), tx.fit(df, lab.where(F.col("toxic") == 0))):
        assert {r.score_ for r in tx.score(df, model).collect()} == {0.0}
    assert tx.score(df.limit(0), tx.fit(df, lab)).count() == 0


def test_rare_words_of_a_small_language_are_found(spark):
    """A handful of toxic rows of a second language, each with stems that are seen few times, is not drowned by the first."""
    docs, labels = corpus(1500)
    rng = np.random.default_rng(9)
    other = ["".join(rng.choice(list("çéèàùlmpqv"), rng.integers(3, 9))) for _ in range(300)]
    ids = []
    for i in range(300):
        text = [str(w) for w in rng.choice(other, 80)]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.choice(80, 3, replace=False):
                text[k] = f"vlop{rng.choice(other)}"
            ids.append(5000 + i)
        docs.append((5000 + i, " ".join(text), None))
        labels.append((5000 + i, int(toxic)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score_ for r in tx.score(df, tx.fit(df, lab)).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0 and i >= 5000]
    assert sum(t for _, t in held) >= 5
    assert np.mean([got[i] >= 0.5 for i, t in held if t]) > 0.75 and np.mean([got[i] < 0.5 for i, t in held if not t]) > 0.95


def test_few_occurrences_and_unseen_continuations_move_the_ratio(spark):
    """Four toxic uses of a stem count, and what never followed the stem backs off to a ratio of its own."""
    rows = [("the grim grin grid of the day " * 50, 0), ("the day of the grid grin " * 10 + "grumba grumbe grumbi grumbo ", 1)]
    counts = tx.gram_counts(spark.createDataFrame(rows, "text string, part int"))
    got = {r.gram: r.ratio for r in tx.ratio_table(counts).where("model = 2").collect()}
    gru = int(tx.grams(["gru"])[0][2])
    assert got[gru] > 0.5
    assert any(k & 255 == tx.NEW for k in got)
    fresh_stem = int(tx.grams(["grzzz"])[0][2])
    assert fresh_stem not in got and got[fresh_stem | tx.NEW] > 0


def test_joined_and_broadcast_tables_score_alike(spark):
    """A table beyond the broadcast bound loses no count: joins give the scores of the index, repeated and empty texts included."""
    docs, labels = corpus(400)
    docs += [(9000, docs[1][1], None), (9001, "", None), (9002, None, None), (9003, "grumfnever zzz grumfnever", None)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    small, large = tx.fit(df, lab), tx.fit(df, lab, broadcast_grams=10)
    assert small.ratios.index is not None and large.ratios.index is None
    want, got = ({r.doc_id: r.score_ for r in tx.score(df, m).collect()} for m in (small, large))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert large.score(["grumfly"]) == pytest.approx(small.score(["grumfly"]), abs=1e-6)


def test_once_seen_grams_stay_in_the_table(spark):
    """However many grams there are, those seen once keep their part in type counts and in the table."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    texts = [" ".join([word() for _ in range(3000)]) for _ in range(12)]
    counts = tx.gram_counts(spark.createDataFrame([(t, i % 4) for i, t in enumerate(texts)], "text string, part int"))
    once = {r.gram for r in counts.where("c0 + c1 + c2 + c3 = 1").collect()}
    kept = {r.gram for r in tx.ratio_table(counts).where("model = 2").collect()}
    assert len(once & kept) > 1000


def test_roots_are_the_first_bytes():
    keys, roots = tx.rooted_grams(["Über x", "", "abcd"])
    assert (keys == tx.grams(["Über x", "", "abcd"])[0]).all() and len(keys) == 13
    number = lambda raw: int.from_bytes(raw[: tx.ROOT], "big")
    assert roots.tolist() == [-1] * 3 + [number("über".encode())] * 3 + [-1] * 2 + [-1] * 3 + [number(b"abcd")] * 2


def test_words_of_rare_counts_travel_and_the_others_are_read(spark):
    values = spark.range(1000).selectExpr("id AS word", "double(id) AS value", "CASE WHEN id < 100 THEN 50 + id WHEN id < 300 THEN 7 ELSE 1 END AS n")
    for most, words in ((1000, 1000), (999, 300), (300, 300), (299, 100), (0, 0)):
        assert sorted(r.word for r in tx.frequent_words(values, most).collect()) == list(range(words))
    assert tx.frequent_words(values, 40).count() <= 40
    assert tx.frequent_words(values.limit(0), 40).count() == 0
    wide = spark.range(200_000).selectExpr("id AS word", "0.0D AS value", "2L AS n")
    assert tx.frequent_words(wide, tx.BROADCAST).count() == 200_000
    files = tx.materialise(wide, "values").inputFiles()
    words, worth = tx.values_in(files)
    assert words.tolist() == list(range(200_000)) and not worth.any()
    assert len(tx.values_in([])[0]) == 0


def test_words_are_asked_for_once_a_question_and_answered_in_packs(spark, monkeypatch):
    """No row for a text and a word: 200 texts with 40 words each ask in one packed row a task and bucket, and equal the plain sums."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgé"), 7)) for _ in range(500)]
    texts = [" ".join(rng.choice(vocabulary, 40)) for _ in range(200)] + ["", "ab", "ab"]
    worth = {int(tx._words([w])[0][0]): float(rng.normal()) for w in [*vocabulary, "ab"]}
    values = spark.createDataFrame(list(worth.items()), "word long, value double")
    df = spark.createDataFrame(list(enumerate(texts)), "digest long, text string").coalesce(1)
    read = tx.materialise(values.where("pmod(word, 3) = 0"), "few").inputFiles()
    for gathered, most in ((1 << 19, 1), (500, 30)):
        monkeypatch.setattr(tx, "GATHERED", gathered)
        asked = tx.materialise(tx.questions(df, read, 7), "asked")
        own = asked.where("bucket < 0").count()
        assert own <= most and asked.count() <= 8 * own and asked.where("bucket >= 0").agg(F.max("bucket")).first()[0] == 6
        got = {r.digest: r["mean"] for r in tx.answered(asked, values.where("pmod(word, 3) != 0"), 7).collect()}
        for i, text in enumerate(texts):
            keys = tx._words([text])[0].tolist()
            assert got[i] == pytest.approx(sum(worth[k] for k in keys) / (len(keys) + tx.STEADY), abs=1e-12)
    empty = tx.materialise(tx.questions(df.limit(0), read, 7), "asked")
    assert tx.answered(empty, values, 7).count() == 0
