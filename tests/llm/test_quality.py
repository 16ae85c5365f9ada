"""Quality rules against a plain Python count, and the promise of the cutoffs."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(j for i in at for j in (i, i + 1, i + 2))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


TEXTS = [
    None, "", " \n\t ", "one", "a b c", "a b c d a b c", "x x x x x x", "l1 a\nl1 a\n\n \nl1 a\n", "# * $ % & | < > ok", "é ü 漢字 x y\x0bz",
    "w " * 5000, "a b c " * 30 + "tail of words", " ".join(f"t{i}" for i in range(20000)), "a b c x a b c y b c x",
]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r[0]: tuple(r)[1:7] for r in quality.judge(df, labels).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), (i, got[i], brute(t))


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.05), (3, 100, 0.05), (40, 2000, 0.05), (0, 1, 0.01), (180, 20000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
    row = spark.createDataFrame([(k, n)], "k long, n long").select(quality.tail(F.col("k"), F.col("n"), p).alias("t")).first()
    assert row.t == pytest.approx(exact if k < n * p else 1.0, rel=1e-6)


def test_cutoffs_keep_their_promise_and_use_the_slack(spark):
    # 20,000 good documents; one in a thousand has a large share of symbols.
    good = spark.range(20000).select(
        F.lit("en").alias("stratum"), F.when(F.col("id") % 1000 == 0, 60).otherwise(F.col("id") % 5).cast("int").alias("symbol_share"),
        *[F.lit(20).alias(r) for r in quality.RULES if r != "symbol_share"],
    )
    cut = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(good).collect()}
    assert 5 <= cut["en", "symbol_share"] <= 60
    few = good.limit(20)
    assert quality.cutoffs(few).count() == 0


def test_nulls_ties_empty_and_extra_columns(spark):
    schema = "doc_id long, text string, lang string, kept string, n_words string"
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(None, text, None, "x", "y"), (1, text, "en", "x", "y"), (1, text, "en", "x", "y"), (2, None, None, None, None)], schema)
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.judge(df, labels).collect())
    assert rows == [(0, 60, True), (1, 60, True), (1, 60, True), (2, 0, False)]
    assert quality.judge(df.limit(0), labels).count() == 0


@pytest.mark.parametrize(("k", "n", "p"), [(1900, 200_000, 0.01), (1900, 200_001, 0.01), (9540, 1_000_000, 0.01), (9600, 1_000_000, 0.01), (9999, 1_000_000, 0.01), (0, 1_000_000, 1e-5), (3, 1_000_000, 1e-5), (499_500, 50_000_000, 0.01)])
def test_binomial_tail_is_exact_for_large_strata(spark, k, n, p):
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    want = math.fsum(math.exp(log(i)) for i in range(max(0, k - 20_000), k + 1))
    row = spark.createDataFrame([(k, n)], "k long, n long").select(quality.tail(F.col("k"), F.col("n"), p).alias("t")).first()
    assert row.t == pytest.approx(want, rel=1e-5)
