"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules reject a document outright. Beyond them, each statistic gets a cutoff per stratum from labelled holdouts: a
cutoff is usable when an exact binomial bound shows, at the corrected level, that rejecting past it loses at most ``risk`` of
the good documents of the stratum; the strictest usable one is taken. All (stratum, rule, cutoff) tests share the error level
``delta`` by Bonferroni's correction, so with probability ``1 - delta`` every chosen cutoff keeps its promise at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.columns import SPACE, WORD
from tidemark.session import materialise

#: Statistics and the direction in which a document gets worse.
RULES = {"symbol_share": 1, "dup_line_share": 1, "repeat_share": 1, "mean_word": 1, "short_words": -1}
#: Cutoffs are whole multiples of 1 / STEPS of a statistic's range.
STEPS = 100


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared by 64-bit digest. Only a text that has equal windows sorts (digest, position); each repeated
    window then counts the words up to the next one, three at most.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(marks: Column) -> Column:
        pairs = F.array_sort(F.transform(marks, lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
        same = lambda s, i: F.coalesce(F.get(s, i)["m"] == F.get(s, i - 1)["m"], F.lit(False)) | F.coalesce(F.get(s, i)["m"] == F.get(s, i + 1)["m"], F.lit(False))
        starts = once(pairs, lambda s: F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(same(s, i), x["i"])), lambda p: p.isNotNull())))
        return once(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b))

    def total(marks: Column) -> Column:
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0)).otherwise(covered(marks))

    return once(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(once(windows(w), total))).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """The base counts of one text; a null text has no words.

    ``word_chars`` code points in words, ``n_symbols`` characters of ``[#*$%&|<>]``, ``n_dup_lines`` lines that have a word
    and equal an earlier line, ``n_repeat_words`` see :func:`repeated_words`.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0), lambda x: F.xxhash64(x))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    both = once(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    return {
        "both": both,
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": once(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
    }


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``key, stratum`` and the base counts, ``base_failed`` and the statistics of :data:`RULES` as steps (0 to STEPS)."""
    s = statistics(F.col(text))
    first = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), s["both"].alias("both"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("lines"))
    counted = first.select(
        "doc_id", "stratum", F.col("both.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.d").alias("n_dup_lines"), F.col("both.r").alias("n_repeat_words"), F.col("lines.n").alias("n_lines")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = lambda part, whole: F.floor(F.least(F.try_divide(F.lit(STEPS) * part, whole), F.lit(STEPS)))
    mean = F.try_divide(F.col("word_chars"), F.col("n_words"))
    steps = {
        "symbol_share": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word": F.floor(F.least(mean * 4, F.lit(STEPS))),
        "short_words": F.floor(F.least(mean * 4, F.lit(STEPS))),
    }
    return counted.withColumn("base_failed", failed).withColumns({k: F.coalesce(v, F.lit(0)).cast("int") for k, v in steps.items()})


def stirling_rest(x: Column) -> Column:
    """What ``log(x!)`` has beyond ``(x + 1/2) log(x) - x + log(2 pi) / 2``, for x from 1 on: a table up to 15, the series beyond."""
    table = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi)) for i in range(1, 16)])
    v = x.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * v * v)) / (v * v)) / (v * v)) / v
    return F.when(x <= 15, F.element_at(table, F.greatest(F.least(x, F.lit(15)), F.lit(1)).cast("int"))).otherwise(series)


def tail(k: Column, n: Column, p: float) -> Column:
    """P(at most ``k`` of ``n``) under rate ``p``, exact at every size; 1 from the mean on.

    The logarithm of the term for ``k`` comes from Stirling's series. Below the mean the term ``m`` steps down is at most
    ``exp(-m (m - 1) / (2 n p))`` of it, so after ``10 sqrt(n p)`` steps nothing is left that a double could hold.
    """
    i = F.greatest(k, F.lit(1)).cast("long")
    whole, part, rest = n.cast("double"), i.cast("double"), F.greatest(n - i, F.lit(1)).cast("double")
    q = part / whole
    far = whole * (q * F.log(q / p) + (1 - q) * F.log((1 - q) / (1 - p)))
    top = stirling_rest(n) - stirling_rest(i) - stirling_rest(n - i) - far - 0.5 * F.log(2 * math.pi * part * rest / whole)
    least = F.greatest(i - F.ceil(10 * F.sqrt(whole * p)) - 10, F.lit(1)).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, at: Column) -> Column:
        term = acc["term"] * at.cast("double") / (n - at + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    terms = F.aggregate(F.sequence(i, least, F.lit(-1).cast("long")), start, step, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k <= 0, F.exp(n * F.log(F.lit(1 - p)))).otherwise(F.exp(top + F.log(terms)))


def cutoffs(sample: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stratum, rule, cutoff``: the strictest step whose loss of good documents is bounded by ``risk / len(RULES)``.

    ``sample`` has one row per labelled good document that passes the base rules: ``stratum`` and the rules' steps. Rows are
    summed per (stratum, rule, step) first; all later work is on that small grid. A stratum with too few good documents to
    prove anything gets no cutoff, and so loses no document.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), (F.col(rule) if sign > 0 else STEPS - F.col(rule)).alias("step")) for rule, sign in RULES.items()])).alias("x")
    grid = sample.select("stratum", pairs).groupBy("stratum", "x.rule", "x.step").agg(F.count("*").alias("good"))
    worse = Window.partitionBy("stratum", "rule").orderBy(F.col("step").desc())
    whole = Window.partitionBy("stratum", "rule")
    # Cutoff c rejects the steps from c on. Between the steps that occur nothing changes, so those are all the tests.
    tests = grid.withColumn("lost", F.sum("good").over(worse)).withColumn("n", F.sum("good").over(whole))
    tests = materialise(tests, "quality-tests")
    # The level depends on how many tests there are, not on their outcome; risks of the rules add up to ``risk``.
    level, each = delta / (max(1, tests.select("stratum").distinct().count()) * len(RULES) * (STEPS + 2)), risk / len(RULES)
    passed = tests.where(tail(F.col("lost"), F.col("n"), each) <= level)
    # Rejecting only what no good document reached is a test as well, with nothing lost.
    past = tests.groupBy("stratum", "rule").agg((F.max("step") + 1).alias("cutoff"), F.max("n").alias("n"))
    past = past.where(tail(F.lit(0).cast("long"), F.col("n"), each) <= level).select("stratum", "rule", "cutoff")
    return past.unionByName(passed.select("stratum", "rule", F.col("step").alias("cutoff"))).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed`` and ``kept``.

    Null text has no words and fails; a null stratum is a stratum of its own; unlabelled and base-failed documents take no
    part in fitting; without labels nothing beyond the base rules is rejected; repeated rows are judged alike, and a document
    with several labels counts once per distinct label.
    """
    rows = materialise(measured(docs, key, text, stratum), "quality-counts")
    good = labels.where(F.col("quality") == 1).select(F.col(key).alias("good_id")).distinct()
    sample = rows.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("good_id"), "left_semi")
    cut = cutoffs(sample, risk, delta)
    wide = cut.groupBy(F.col("stratum").alias("of")).agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])
    wide = materialise(wide, "quality-cutoffs")
    over = F.lit(False)
    for rule, sign in RULES.items():
        step = F.col(rule) if sign > 0 else STEPS - F.col(rule)
        over = over | F.coalesce(step >= F.col(f"cut_{rule}"), F.lit(False))
    joined = rows.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
