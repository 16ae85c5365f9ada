"""Phrase collocations from depth-truncated suffix subtrees, built group by group over vertically partitioned prefixes.

The string of a language is its words; a suffix starts at every word, ends with its piece and is cut after ``DEPTH`` words.
Prefixes are partitioned by frequency. A word or a pair of words below the least count can start no candidate, so a suffix is
also cut before the first pair that is too rare. A word within the memory budget is a prefix of its own; a more frequent one is
extended by its second word; and where even the pair is over the budget, its suffixes are dealt over all groups. Prefixes are
dealt into as many groups as the budget asks for. Each group, on its own, sorts its suffixes into a subtree: a node is a range of
equal beginnings and its count the total of the leaves below. Only pairs that were dealt over all groups have their nodes added
up afterwards.

Every suffix leaves its task once per block of text with a count, so a hot phrase costs a row per block and not one per
occurrence. Words travel as 64-bit digests seeded by language; a digest that a counted word shares with any other is looked for,
and another seed taken if there is one. The words and pairs that are frequent enough go to the tasks as bitmaps of a fixed size:
a bit set in error only costs rows, which fall out when counts are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.columns import with_small
from tidemark.llm.words import numbered, numbering
from tidemark.session import materialise

#: Longest phrase, least count of a candidate, rows of the report per language.
DEPTH, LEAST, TOP = 4, 30, 2000
#: Runs that end a piece, and words. Texts are lower-cased bytes, so only A-Z change.
TOKEN = re.compile(rb"[.,;:!?\n-\r]+|[^ \t.,;:!?\n-\r]+")
ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
RUN = re.compile(rb"[.,;:!?\n-\r]*[^ \t.,;:!?\n-\r]*")
#: Words of a block, suffixes of a group, and bits of a bitmap (as a power of two).
BLOCK_WORDS, BUDGET, BITS = 1 << 20, 1 << 19, 25
WORDS = ["h1", "h2", "h3", "h4"]


def _blocks(batches: Iterator[pa.RecordBatch], seed: int, size: int) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """``(lang, words, digests, numbers)`` per language and block: the words met, their digests, and the text as numbers.

    Number 0 is the end of a piece or text and has digest 0. A text is numbered whole, however long it is.
    """
    held: dict[str, tuple] = {}
    total = 0

    def flush() -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        for lang, (numbers, parts) in held.items():
            start = xxhash.xxh64_intdigest(lang.encode(), seed)
            words = list(numbers)
            ends = np.array([w[0] in ENDS if w else True for w in words])
            digests = np.array([0 if end else xxhash.xxh64_intdigest(w, start) or 1 for w, end in zip(words, ends, strict=True)], np.uint64).view(np.int64)
            text = np.concatenate(parts)
            yield lang, words, digests, np.where(ends[text], 0, text)

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang not in held:
                held[lang] = (numbering(), [])
                held[lang][0][b""]
            numbers, parts = held[lang]
            text = numbered(raw.as_buffer().to_pybytes().lower(), TOKEN, RUN, numbers)
            parts += [text, np.zeros(1, np.int32)]
            total += len(text)
            if total >= size:
                yield from flush()
                held, total = {}, 0
    yield from flush()


def _bit(first: Column, second: Column | None = None) -> Column:
    """The place of a word or a pair in a bitmap: high bits of the one, other bits of the other."""
    bit = F.shiftrightunsigned(first, 64 - BITS)
    return bit if second is None else bit.bitwiseXOR(F.shiftrightunsigned(second, 10).bitwiseAND(F.lit((1 << BITS) - 1)))


def _bits(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    bit = (first.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
    return bit if second is None else bit ^ ((second.view(np.uint64) >> np.uint64(10)).astype(np.int64) & ((1 << BITS) - 1))


class Bitmap:
    """``2 ** BITS`` bits, gathered on the driver in rows of 4 KB."""

    def __init__(self, df: DataFrame, bit: Column) -> None:
        # Spark numbers the bits of a bitmap from 1.
        bits = df.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        raw = bytearray(1 << BITS >> 3)
        for r in bits.collect():
            raw[(r["at"] - 1) * 4096 : r["at"] * 4096] = r["bits"]
        self.handle = df.sparkSession.sparkContext.broadcast(bytes(raw))

    def has(self, bits: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(self.handle.value, np.uint8)
        return (raw[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame, least: int, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """``lang, word, h, f`` over all words, and the seed under which no word with ``least`` occurrences shares a digest."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("f", pa.int64())])
    seed = 0
    while True:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, words, digests, text in _blocks(batches, seed, block_words):  # noqa: B023
                counts = np.bincount(text, minlength=len(words))
                at = np.flatnonzero((counts > 0) & (digests != 0))
                names = pa.array([words[i] for i in at], pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.repeat(pa.scalar(lang), len(at)), names, pa.array(digests[at]), pa.array(counts[at].astype(np.int64))], schema=schema)

        parts = texts.mapInArrow(count, "lang string, word string, h long, f long")
        words = materialise(parts.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("f").alias("f")), "phrase-words")
        shared = words.groupBy("h").agg(F.count("*").alias("n"), F.max("f").alias("f")).where((F.col("n") > 1) & (F.col("f") >= least))
        if shared.isEmpty():
            return words, seed
        seed += 1


def pair_counts(texts: DataFrame, words: Bitmap, seed: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``h1, h2, f`` of neighbouring frequent words of a piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, digests, text in _blocks(batches, seed, block_words):
            known = digests != 0
            known[known] = words.has(_bits(digests[known]))
            both = known[text[:-1]] & known[text[1:]]
            pair, n = np.unique(text[:-1][both].astype(np.int64) * len(digests) + text[1:][both], return_counts=True)
            yield pa.record_batch([pa.array(digests[pair // len(digests)]), pa.array(digests[pair % len(digests)]), pa.array(n.astype(np.int64))], names=["h1", "h2", "f"])

    return texts.mapInArrow(count, "h1 long, h2 long, f long").groupBy("h1", "h2").agg(F.sum("f").alias("f"))


def suffixes(texts: DataFrame, pairs: Bitmap, hot_words: Bitmap, hot_pairs: Bitmap, groups: int, seed: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``part, h1 ... h4, f``: suffixes of three or four words over frequent pairs (``h4`` 0 for three), and their group."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (_, _, digests, text) in enumerate(_blocks(batches, seed, block_words)):
            h = digests[text]
            goes = np.zeros(len(h), bool)
            both = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
            goes[both] = pairs.has(_bits(h[both], h[both + 1]))
            goes = np.concatenate([goes, np.zeros(3, bool)])
            three = goes[: len(h)] & goes[1 : len(h) + 1]
            four = three & goes[2 : len(h) + 2]
            # Numbers of pairs, so that four words make one key.
            at = np.flatnonzero(goes)
            pair, number = np.unique(text[at].astype(np.int64) * len(digests) + text[at + 1], return_inverse=True)
            of = np.zeros(len(h) + 3, np.int64)
            of[at] = number
            short, full = np.flatnonzero(three & ~four), np.flatnonzero(four)
            key_short, n_short = np.unique(of[short] * len(pair) + of[short + 1], return_counts=True)
            key_full, n_full = np.unique(of[full] * len(pair) + of[full + 2], return_counts=True)
            w1, w2 = np.divmod(pair, len(digests))
            a, b = np.divmod(key_short, max(len(pair), 1))
            c, d = np.divmod(key_full, max(len(pair), 1))
            cols = [
                np.concatenate([digests[w1[a]], digests[w1[c]]]),
                np.concatenate([digests[w2[a]], digests[w2[c]]]),
                np.concatenate([digests[w2[b]], digests[w1[d]]]),
                np.concatenate([np.zeros(len(a), np.int64), digests[w2[d]]]),
            ]
            # A word is a prefix, or a pair where the word is hot; suffixes of a hot pair go anywhere.
            place = cols[0].view(np.uint64).copy()
            long = hot_words.has(_bits(cols[0]))
            place[long] ^= np.uint64(0x9E3779B97F4A7C15) * cols[1][long].view(np.uint64)
            dealt = hot_pairs.has(_bits(cols[0], cols[1]))
            place[dealt] ^= cols[2][dealt].view(np.uint64) * np.uint64(3) + cols[3][dealt].view(np.uint64) * np.uint64(5) + np.uint64(turn)
            part = (place >> np.uint64(1)) % np.uint64(groups)
            counts = np.concatenate([n_short, n_full]).astype(np.int64)
            yield pa.record_batch([pa.array(part.astype(np.int64)), *map(pa.array, cols), pa.array(counts), pa.array(dealt)], names=["part", *WORDS, "f", "dealt"])

    return texts.mapInArrow(cut, "part long, h1 long, h2 long, h3 long, h4 long, f long, dealt boolean")


def subtree(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """The nodes of depth three and four over the suffixes of one group, with the totals of their leaves.

    Nodes below ``least`` are left out, but for parts of pairs that other groups have a share of.
    """
    path = frame[WORDS].to_numpy(np.int64)
    order = np.lexsort(path.T[::-1])
    path, f, dealt = path[order], frame["f"].to_numpy(np.int64)[order], frame["dealt"].to_numpy(bool)[order]
    out = []
    for depth in (3, 4):
        # A node starts where the path to its depth differs from the one before.
        first = np.flatnonzero(np.append(True, (path[1:, :depth] != path[:-1, :depth]).any(1)))
        node = path[first].copy()
        node[:, depth:] = 0
        total = np.add.reduceat(f, first)
        kept = (total >= least) | dealt[first]
        if depth == 4:
            kept &= node[:, 3] != 0
        out.append(pd.DataFrame(node[kept], columns=WORDS).assign(f=total[kept]))
    return pd.concat(out)


def phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang", budget: int = BUDGET, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of one to ``DEPTH`` words with ``least`` occurrences or more, the words behind their digests, and sizes.

    The first has ``h1 ... h4`` (0 beyond the phrase) and ``f``; the second ``lang, word, h, f``; the third ``lang, n``.
    """
    texts = _texts(docs, text, lang)
    words, seed = word_counts(texts, least, block_words)
    frequent = words.where(F.col("f") >= least)
    pairs = pair_counts(texts, Bitmap(frequent, _bit(F.col("h"))), seed, block_words).where(F.col("f") >= least)
    pairs = materialise(pairs, "phrase-pairs")
    total = pairs.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // budget))
    hot_words = Bitmap(frequent.where(F.col("f") > budget // 8), _bit(F.col("h")))
    hot_pairs = Bitmap(pairs.where(F.col("f") > budget // 8), _bit(F.col("h1"), F.col("h2")))
    leaves = suffixes(texts, Bitmap(pairs, _bit(F.col("h1"), F.col("h2"))), hot_words, hot_pairs, groups, seed, block_words)
    nodes = leaves.groupBy("part").applyInPandas(lambda frame: subtree(frame, least), "h1 long, h2 long, h3 long, h4 long, f long")
    longer = nodes.groupBy(*WORDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    none = F.lit(0).cast("long")
    ones = frequent.select(F.col("h").alias("h1"), none.alias("h2"), none.alias("h3"), none.alias("h4"), "f")
    twos = pairs.select("h1", "h2", none.alias("h3"), none.alias("h4"), "f")
    return materialise(ones.unionByName(twos).unionByName(longer), "phrases"), frequent, words.groupBy("lang").agg(F.sum("f").alias("n"))


def _parts(words: Column, size: Column, spans: list[tuple[int, int]]) -> list[Column]:
    """``words`` from ``a`` up to ``b`` (exclusive) as four digests, for each ``(a, b)`` within ``size``; null beyond it."""
    none = F.lit(0).cast("long")
    cell = lambda a, b, i: F.element_at(words, a + i + 1) if a + i < b else none
    return [F.when(size >= b, F.struct(*[cell(a, b, i).alias(w) for i, w in enumerate(WORDS)])) for a, b in spans]


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", budget: int = BUDGET, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two to ``DEPTH`` words.

    A null text is empty and a null language ``und``; a text is as long as it is, and every row counts, repeated ones too. An
    empty table, or one without a frequent pair, has no rows. Scores are ``2000000 * a`` div ``l + r`` in decimals.
    """
    found, names, sizes = phrases(docs, least, text, lang, budget, block_words)
    size = F.when(F.col("h2") == 0, 1).when(F.col("h3") == 0, 2).when(F.col("h4") == 0, 3).otherwise(4)
    candidates = found.where(F.col("h2") != 0).select(F.array(*WORDS).alias("w"), size.alias("size"), F.col("f").alias("a"))
    counts = found.select(F.struct(*WORDS).alias("p"), F.col("f").alias("pf"))
    # Each cut after k words: the counts of both sides are those of frequent phrases.
    w, m = F.col("w"), F.col("size")
    firsts = _parts(w, m, [(0, k) for k in range(1, DEPTH)])
    rests = [F.coalesce(*_parts(w, m, [(k, b) for b in range(DEPTH, k, -1)])) for k in range(1, DEPTH)]
    cuts = F.array(*[F.when(m > k, F.struct(F.lit(k).alias("k"), one.alias("first"), rest.alias("rest"))) for k, one, rest in zip(range(1, DEPTH), firsts, rests, strict=True)])
    cut = candidates.select("w", "a", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c")).select("w", "a", "c.*")
    cut = cut.join(counts.select(F.col("p").alias("first"), F.col("pf").alias("l")), "first").join(counts.select(F.col("p").alias("rest"), F.col("pf").alias("r")), "rest")
    score = F.expr("(CAST(a AS DECIMAL(28, 0)) * 2000000) div (l + r)")
    least_cut = cut.withColumn("score", score).groupBy("w", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best"))
    # Each longer candidate names the phrases inside it.
    inside = F.array(*_parts(w, m, [(a, b) for a in range(DEPTH - 1) for b in range(a + 2, DEPTH + 1)]))
    own = F.struct(*[F.element_at(w, i + 1).alias(name) for i, name in enumerate(WORDS)])
    covers = candidates.where(m > 2).select("a", own.alias("own"), F.explode(inside).alias("p")).where(F.col("p").isNotNull() & (F.col("p") != F.col("own")))
    covers = covers.groupBy("p").agg(F.max("a").alias("cover"))
    kept = least_cut.withColumn("p", own).join(covers, "p", "left").where(F.col("cover").isNull() | (100 * F.col("cover").cast("decimal(28,0)") < 80 * F.col("a").cast("decimal(28,0)")))
    spoken = names.select(F.col("h").alias("p1"), "lang")
    kept = with_small(kept.select("w", "a", "best.*"), spoken, F.element_at("w", 1) == F.col("p1"))
    # Ranks by numbers first, with all ties, so that only what can be reported gets its words.
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialise(kept.withColumn("place", F.rank().over(near)).where(F.col("place") <= top).select("lang", "w", "a", "l", "r", "score"), "phrase-places")
    spelled = with_small(near.select("w", F.posexplode("w").alias("i", "h")).where("h <> 0").withColumnRenamed("h", "wh"), names.select("h", "word"), F.col("wh") == F.col("h"))
    spelled = spelled.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(spelled, "w").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same rows by counting every phrase, for DuckDB.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS one, array_to_string(w[j + 1 :], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, (2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS cover
  FROM (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_ USING (lang, phrase) WHERE cover IS NULL OR 100 * CAST(cover AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
