"""Toxicity by two class-conditional Kneser-Ney models over the bytes of words.

A word is predicted byte by byte, each after all bytes of the word before it. Both classes discount their own counts and back
off to counts of both classes together, which end in a continuation model. The log-likelihood ratio of a continuation is shrunk
by how surely the classes use it differently: by ``z^2 / (z^2 + SURE^2)`` at ``z`` standard deviations. A continuation that no
labelled row has takes the backoff ratio of what it follows: how often either class goes on in a new way there, against what
samples of the classes' sizes would by chance. So a stem that one class prefers is caught whatever follows it, and different
sizes of the classes move nothing by themselves.

The ratio ``w`` of a word is the sum over its bytes. Words that a whole language uses a little more in one class would set a
level for that language, and toxic words are few in a text, so a word counts ``w^5 / (w^4 + MILD^4)``: a clear word in full, a
mild one little. The score is that sum over a text divided by its number of words plus ``STEADY``, mapped to a probability by a
logistic curve; the curve is fitted on values that each half of the labelled rows gets from the other half.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.bytefiles import located
from tidemark.llm.columns import blocks, crc_of_id, flat_bytes, fresh, with_small
from tidemark.llm.hashindex import HashIndex
from tidemark.llm.held import begin
from tidemark.session import materialise

DISCOUNT, STEADY = 0.75, 40
#: Where a continuation's ratio and a word's ratio count half, and types that steady the ratio of new continuations.
SURE, MILD, TYPES = 3.0, 2.0, 5.0
#: The byte under which a context's backoff ratio is kept; UTF-8 has none of that value.
NEW = 255
#: Largest weight of one byte in either direction.
CLIP = 6.0
#: Bytes of a word by which words and ratios are dealt. Shorter contexts are at most 1 + 154 + 154^2, so their ratios are broadcast.
ROOT = 3
#: Words and ratios that one task looks up together, about.
BUCKET = 1 << 18
#: Bytes that are looked up at a time, and n-grams, or texts and words to be asked for, that a task gathers before it passes them on.
BLOCK_BYTES, GATHERED = 1 << 18, 1 << 18
#: Ratios that are broadcast if a table has no more, and else values of its most frequent words that every task reads.
BROADCAST = 1 << 18
#: The columns of a question's rows after its number.
QUESTION = {"bucket": "int", "words": "binary", "digests": "binary", "sizes": "binary", "sums": "binary", "places": "binary", "ranks": "binary"}
#: An odd base for hashes of byte strings, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes that belong to words once a text is lower-cased: ASCII letters and whatever is not ASCII.
LETTER = np.array([97 <= b < 123 or b >= 128 for b in range(256)])
SPLIT = re.compile(rb"[a-z\x80-\xff]+")


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One key for each byte of each word and for the word's end: a hash of the word so far, then the byte in the low 8 bits.

    Returns the keys of all texts in order, where each text's keys start (with the end), and the number of words of each.
    """
    keys, _, ends, words = _grams(texts)
    return keys, ends, words


def rooted_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same keys and each one's root: the first ``ROOT`` bytes of the word as a number, -1 where it has fewer so far."""
    return _grams(texts, rooted=True)[:2]


def _grams(texts: list[str], rooted: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    raw, ends = flat_bytes([t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts])
    size = 1 << max(16, len(raw).bit_length())
    forth, back = powers(BASE, size), powers(BACK, size)
    letter = LETTER[raw]
    at_end = np.zeros(len(raw), bool)
    at_end[1:] = ~letter[1:] & letter[:-1]
    place = np.arange(len(raw))
    # The first byte of the word that a byte is in or ends.
    start = np.maximum.accumulate(np.where(letter, -1, place)) + 1
    start[1:][at_end[1:]] = start[:-1][at_end[1:]]
    at = np.flatnonzero(letter | at_end)
    start = start[at]
    code = np.where(at_end, 0, raw)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forth[: len(raw)], out=sums[1:])
    so_far = (sums[at] - sums[start]) * back[start]
    so_far = (so_far ^ (so_far >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (so_far >> np.uint64(10)).astype(np.int64) << 8 | code[at]
    root = None
    if rooted:
        root = np.zeros(len(at), np.int32)
        for i in range(ROOT):
            root = root << 8 | raw[np.minimum(start + i, max(len(raw) - 1, 0))]
        root[at - start < ROOT] = -1
    return keys, root, np.searchsorted(at, ends), np.diff(np.concatenate([[0], np.cumsum(at_end)])[ends])


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts over some batches, a gram more than once where a task has more distinct ones than it gathers."""
    begin("toxicity")
    empty = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, 4), np.int64)
    table, new = empty, []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, roots, counts = table
        found, at = np.unique(np.concatenate([keys, *(k for k, _, _, _ in new)]), return_inverse=True)
        root, sums = np.empty(len(found), np.int32), np.zeros((len(found), 4), np.int64)
        # A part has each key once, so parts add up one by one and are not copied together.
        root[at[: len(keys)]], sums[at[: len(keys)]] = roots, counts
        start = len(keys)
        for k, r, part, n in new:
            place = at[start : start + len(k)]
            root[place] = r
            sums[place, part] += n
            start += len(k)
        new.clear()
        return found, root, sums

    def frames() -> Iterator[pd.DataFrame]:
        for i in range(0, len(table[0]), GATHERED // 4):
            found, roots, sums = (column[i : i + GATHERED // 4] for column in table)
            yield pd.DataFrame({"gram": found, "root": roots} | {f"c{i}": sums[:, i] for i in range(4)})

    for batch in batches:
        for part in range(4):
            texts = batch["text"][batch["part"] == part].tolist()
            for block in blocks([len(t) for t in texts], BLOCK_BYTES):
                keys, roots = rooted_grams(texts[block])
                found, first, n = np.unique(keys, return_index=True, return_counts=True)
                new.append((found, roots[first], part, n))
                # After every block and not after a batch, whose rows may be many and long.
                if sum(len(k) for k, _, _, _ in new) > GATHERED:
                    table = merged()
                    if len(table[0]) > 2 * GATHERED:
                        yield from frames()
                        table = empty
    table = merged()
    yield from frames()


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, root, c0 .. c3``: counts over all rows of ``text, part``, where part is twice the half plus the class."""
    partial = rows.mapInPandas(counted, "gram bigint, root int, c0 bigint, c1 bigint, c2 bigint, c3 bigint")
    return partial.groupBy("gram").agg(F.max("root").alias("root"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])


def ratio_table(counts: DataFrame) -> DataFrame:
    """``model, root, gram, ratio``: shrunk ratios of all continuations that move a score, for models 0 and 1 (the halves) and 2 (both).

    A gram ends in ``NEW`` for what else may follow its context. No count is left out: rows go only where the ratio is exactly
    0, as after a context that one class alone has or that goes on in a single way, and an absent row reads as 0.
    """
    parts = [F.struct(F.lit(m).alias("model"), t.alias("t"), o.alias("o")) for m, (t, o) in enumerate([(F.col("c1"), F.col("c0")), (F.col("c3"), F.col("c2")), (F.col("c1") + F.col("c3"), F.col("c0") + F.col("c2"))])]
    each = F.explode(F.array(*parts)).alias("p")
    byte = F.col("gram").bitwiseAND(F.lit(255).cast("long")).alias("byte")
    seen = counts.select(byte, each).where("p.t + p.o > 0").groupBy("p.model", "byte").count()
    seen = seen.withColumn("continued", F.col("count") / F.sum("count").over(Window.partitionBy("model"))).drop("count")
    # A context has at most 257 rows; one shuffle by context serves all three models.
    rows = counts.withColumn("context", F.shiftright("gram", 8)).repartition("context").select("context", "root", "gram", byte, each)
    rows = rows.select("context", "root", "gram", "byte", "p.*").where("t + o > 0")
    context = Window.partitionBy("model", "context")
    total = lambda x: F.sum(x).over(context)
    rows = rows.withColumns({"n_t": total("t").cast("double"), "n_o": total("o").cast("double"), "types_t": total((F.col("t") > 0).cast("int")), "types_o": total((F.col("o") > 0).cast("int")), "types": total(F.lit(1)), "head": F.min("gram").over(context)})
    both, n = F.col("t") + F.col("o"), F.col("n_t") + F.col("n_o")
    rows = rows.withColumns({"chance_t": total(1 - F.pow(F.col("n_o") / n, both)), "chance_o": total(1 - F.pow(F.col("n_t") / n, both))})
    rows = rows.join(F.broadcast(seen), ["model", "byte"])
    shared = F.greatest(both - DISCOUNT, F.lit(0.0)) / n + DISCOUNT * F.col("types") / n * F.col("continued")

    def log(own: str) -> Column:
        size = F.col(f"n_{own}")
        return F.log(F.when(size > 0, (F.greatest(F.col(own) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"types_{own}") * shared) / size).otherwise(shared))

    share = both / n
    away = F.pow(F.col("t") - F.col("n_t") * share, 2) / (F.col("n_t") * share * (1 - share) * F.col("n_o") / n + 0.5)
    clipped = lambda x: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x))
    ratio = clipped(log("t") - log("o")) * away / (away + SURE**2)
    steadied = lambda own: F.log((F.col(f"types_{own}") + TYPES) / (F.col(f"chance_{own}") + TYPES))
    one_sided = (F.col("types") == 1) | (F.col("n_t") == 0) | (F.col("n_o") == 0)
    rows = rows.select("model", "root", "gram", "context", "head", ratio.cast("float").alias("ratio"), F.when(one_sided, F.lit(0.0)).otherwise(clipped(steadied("t") - steadied("o"))).cast("float").alias("new"))
    rest = F.struct((F.shiftleft("context", 8) + NEW).alias("gram"), F.col("new").alias("ratio"))
    own = F.struct("gram", "ratio")
    out = rows.where("ratio != 0 OR new != 0").select("model", "root", F.explode(F.when((F.col("gram") == F.col("head")) & (F.col("new") != 0), F.array(own, rest)).otherwise(F.array(own))).alias("g"))
    return out.select("model", "root", "g.*")


def word_value(ratio: np.ndarray) -> np.ndarray:
    """What words with these ratios count."""
    return ratio**5 / (ratio**4 + MILD**4)


@dataclass
class Ratios:
    """The table of one model, as an index as well if it has few enough rows to be broadcast."""

    table: DataFrame
    index: Lookup | None
    most: int = BROADCAST

    @classmethod
    def of(cls, table: DataFrame, most: int) -> Ratios:
        if table.limit(most + 1).count() > most:
            return cls(table, None, most)
        return cls(table, indexed(table), most)

    def add_means(self, docs: DataFrame, text: str, into: str) -> DataFrame:
        """``docs`` with the value of each text as ``into``."""
        if self.index is None:
            return _joined_means(docs, self.table, text, into, self.most)
        shared, at = docs.sparkSession.sparkContext.broadcast(self.index), docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = means([t or "" for t in batch.column(at).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, into])

        return docs.mapInArrow(run, docs.withColumn(into, F.lit(0.0)).schema)


class Lookup:
    """A table that travels as its rows; whoever looks something up builds the index, once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.index = keys, values, None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "index": None}

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        if self.index is None:
            self.index = HashIndex(self.keys, self.values)
        return self.index.get(keys, missing)


def indexed(table: DataFrame) -> Lookup:
    rows = table.select("gram", "ratio").toArrow()
    return Lookup(rows["gram"].to_numpy(), rows["ratio"].to_numpy())


def means(texts: list[str], index: Lookup) -> np.ndarray:
    """The summed values of the words of each text over their number; 0 for a text without words."""
    out = []
    for block in blocks([len(t) for t in texts], BLOCK_BYTES):
        keys, ends, words = grams(texts[block])
        ratio = index.get(keys, np.nan)
        new = np.flatnonzero(np.isnan(ratio))
        ratio[new] = index.get(keys[new] | NEW, 0.0)
        # A word's last key has byte 0; bincount adds in order, so a text's value does not hang on its neighbours.
        last = (keys & 255) == 0
        value = word_value(np.bincount(np.cumsum(last) - last, ratio, int(last.sum())))
        out.append(np.bincount(np.repeat(np.arange(len(words)), words), value, len(words)) / (words + STEADY))
    return np.concatenate(out) if out else np.zeros(0)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words in order (their last grams), and where each text's words end."""
    keys, _, words = grams(texts)
    return keys[(keys & 255) == 0], np.cumsum(words)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, bytes, n``: every word of ``text`` with its occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("toxicity")
        held: dict[bytes, int] = {}
        frame = lambda: pd.DataFrame({"bytes": list(held), "n": list(held.values())})
        for batch in batches:
            for text in batch["text"]:
                for word in SPLIT.findall(text.lower().encode("utf-8", "surrogatepass")):
                    held[word] = held.get(word, 0) + 1
                if len(held) > GATHERED // 4:
                    yield frame()
                    held.clear()
        if held:
            yield frame()

    return texts.mapInPandas(run, "bytes binary, n bigint").groupBy("bytes").agg(F.sum("n").alias("n"))


def word_values(words: DataFrame, table: DataFrame) -> DataFrame:
    """``word, value, n``: what each of ``words`` counts by the table.

    All steps of a word after its first ``ROOT`` bytes have its root, so words and ratios meet in buckets of roots: each travels
    once, and a word's steps never leave its row. The number of buckets follows the rows; one holds a root at least.
    """
    few = indexed(table.where("root < 0"))
    short = words.sparkSession.sparkContext.broadcast(few)
    longer = table.where("root >= 0")
    n_buckets = max(1, -(-(words.count() + longer.count()) // BUCKET))

    def run(w: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        index = Lookup(t["gram"].to_numpy(np.int64), t["ratio"].to_numpy(np.float32))

        def get(keys: np.ndarray) -> np.ndarray:
            found = index.get(keys, np.nan)
            away = np.flatnonzero(np.isnan(found))
            found[away] = short.value.get(keys[away], np.nan)
            return found

        out, raw = [], w["bytes"].tolist()
        for block in blocks([len(word) for word in raw], BLOCK_BYTES):
            keys, _, _ = grams([word.decode("utf-8", "surrogatepass") for word in raw[block]])
            ratio = get(keys)
            new = np.flatnonzero(np.isnan(ratio))
            ratio[new] = np.nan_to_num(get(keys[new] | NEW))
            last = (keys & 255) == 0
            out.append(pd.DataFrame({"word": keys[last], "value": word_value(np.bincount(np.cumsum(last) - last, ratio, int(last.sum()))), "n": w["n"].to_numpy()[block]}))
        return pd.concat(out) if out else pd.DataFrame({"word": [], "value": [], "n": []})

    bucket = lambda root: F.pmod(F.xxhash64(root), F.lit(n_buckets)).alias("bucket")
    root = F.conv(F.hex(F.substring("bytes", 1, ROOT)), 16, 10).cast("int")
    left = words.select(bucket(root), "bytes", "n").groupBy("bucket")
    return left.cogroup(longer.select(bucket(F.col("root")), "gram", "ratio").groupBy("bucket")).applyInPandas(run, "word bigint, value double, n bigint")


def _least_count(values: DataFrame, most: int) -> int | None:
    """The least ``n`` that at most ``most`` words reach, none if there is no such bin. Sizes of bins of ``n`` decide, nothing is sorted."""
    upto, bin_ = None, F.floor(F.log2("n") * 16)
    for row in values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("bin")).collect():
        most -= row.words
        if most < 0:
            break
        upto = row.n
    return upto


def frequent_words(values: DataFrame, most: int) -> DataFrame:
    """The rows of ``values`` whose word occurs so often (``n``) that at most ``most`` words do."""
    upto = _least_count(values, most)
    return values.limit(0) if upto is None else values.where(F.col("n") >= upto)


def values_in(files: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words of some files of ``word, value`` in ascending order, and their values."""
    parts = []
    for file in files:
        system, inner = located(file)
        with system.open_input_file(inner) as opened:
            parts.append(pq.ParquetFile(opened).read(["word", "value"]))
    words, values = (np.concatenate([p[name].to_numpy() for p in parts] + [np.zeros(0, kind)]) for name, kind in (("word", np.int64), ("value", np.float64)))
    order = np.argsort(words)
    return words[order], values[order]


def questions(texts: DataFrame, files: list[str], n_buckets: int) -> DataFrame:
    """The ``digest, text`` rows of ``texts`` as packed questions for the values of their words, beside what is known without asking.

    A task gathers texts into a question. Its row of bucket -1 has for each text the digest, the number of words and the sum of the
    values that ``files`` hold, and for each other occurrence the place of its text and of its word. Those words, each once, are in
    the rows of their buckets, in order of bucket and word. So a word travels once a question, however many of its texts have it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("toxicity")
        known, worth = values_in(files)
        task, asked = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []

        def question() -> pd.DataFrame:
            nonlocal asked
            digests, sizes, sums, places, words = zip(*held, strict=True)
            starts = np.cumsum([0, *map(len, digests[:-1])])
            place = np.concatenate([at + start for at, start in zip(places, starts, strict=True)])
            words, of = np.unique(np.concatenate(words), return_inverse=True)
            bucket = bucket_of(words, n_buckets)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            buckets, first = np.unique(bucket[order], return_index=True)
            own = (np.concatenate(digests), np.concatenate(sizes).astype(np.int32), np.concatenate(sums), place.astype(np.int32), rank[of])
            rows = [(-1, b"", *(column.tobytes() for column in own))]
            rows += [(int(k), part.tobytes(), *[b""] * len(own)) for k, part in zip(buckets, np.split(words[order], first[1:]) if len(first) else [], strict=True)]
            held.clear()
            asked += 1
            return pd.DataFrame([(task << 32 | asked, *row) for row in rows], columns=["question", *QUESTION])

        for batch in batches:
            for block in blocks([len(t) for t in batch["text"]], BLOCK_BYTES):
                words, ends = _words(batch["text"].iloc[block].tolist())
                size = np.diff(ends, prepend=0)
                place = np.repeat(np.arange(len(size)), size)
                # Each distinct word is looked up once, in order.
                distinct, back = np.unique(words, return_inverse=True)
                near = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
                value = (np.where(known[near] == distinct, worth[near], np.nan) if len(known) else np.full(len(distinct), np.nan))[back]
                away = np.isnan(value)
                held.append((batch["digest"].iloc[block].to_numpy(), size, np.bincount(place, np.where(away, 0.0, value), len(size)), place[away], words[away]))
                if sum(len(part[0]) + len(part[-1]) for part in held) > GATHERED:
                    yield question()
        if held:
            yield question()

    return texts.mapInPandas(run, "question bigint, " + ", ".join(f"{name} {kind}" for name, kind in QUESTION.items()))


def bucket_of(word, n_buckets: int):
    """The bucket in which a word's value lies; of a column or of an array. The byte of a key's end says nothing."""
    return F.pmod(F.shiftright(word, 8), F.lit(n_buckets)).cast("int") if isinstance(word, Column) else (word >> 8) % n_buckets


def answered(asked: DataFrame, values: DataFrame, n_buckets: int) -> DataFrame:
    """``digest, mean`` of every text of ``asked``, with the ``word, value`` rows of ``values``.

    Questions and values meet in buckets of words, then a question's answers come back together. Equal texts get equal means.
    """

    def look(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(v["word"].to_numpy(np.int64))
        words, each = v["word"].to_numpy(np.int64)[order], v["value"].to_numpy(float)[order]
        found = [each[np.searchsorted(words, np.frombuffer(raw, np.int64))].tobytes() for raw in q["words"]]
        return pd.DataFrame({"question": q["question"], "bucket": q["bucket"], "found": found})

    def mean(q: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        kinds = {"digests": np.int64, "sizes": np.int32, "sums": float, "places": np.int32, "ranks": np.int32}
        digests, sizes, sums, places, ranks = (np.frombuffer(q[name].iloc[0], kind) for name, kind in kinds.items())
        found = np.frombuffer(b"".join(a.sort_values("bucket")["found"]), float)
        return pd.DataFrame({"digest": digests, "mean": (sums + np.bincount(places, found[ranks], len(digests))) / (sizes + STEADY)})

    known = values.select("word", "value", bucket_of(F.col("word"), n_buckets).alias("bucket")).groupBy("bucket")
    found = asked.where("bucket >= 0").select("question", "bucket", "words").groupBy("bucket").cogroup(known).applyInPandas(look, "question bigint, bucket int, found binary")
    own = asked.where("bucket < 0").drop("bucket", "words").groupBy("question")
    return own.cogroup(found.groupBy("question")).applyInPandas(mean, "digest bigint, mean double")


def _joined_means(docs: DataFrame, table: DataFrame, text: str, into: str, most: int = BROADCAST) -> DataFrame:
    """The same by joins: distinct words with the table, then the words of texts with the words' values.

    Up to ``most`` of the most frequent words are read from the shared folder by every task, so that the driver never holds
    them, and summed where the text is read; the others are asked for, packed, by many texts together. Texts are known by a
    64-bit digest; equal texts share the mean.
    """
    digest, = fresh(docs, "digest")
    name = F.xxhash64
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocabulary = materialise(word_counts(texts), "toxicity-vocabulary")
    values = materialise(word_values(vocabulary, table), "toxicity-words")
    upto = _least_count(values, most)
    read, rest = (values.limit(0), values) if upto is None else (values.where(F.col("n") >= upto), values.where(F.col("n") < upto))
    files = materialise(read.select("word", "value"), "toxicity-frequent").inputFiles()
    # A bucket's words, and how often they can be asked for.
    size = rest.agg(F.count("*") + F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-size // (4 * BUCKET)))
    # Written once, so that a question's rows come from one run of its task.
    asked = materialise(questions(texts.select(name("text").alias("digest"), "text"), files, n_buckets), "toxicity-questions")
    sums = answered(asked, rest, n_buckets).groupBy(F.col("digest").alias("of")).agg(F.max("mean").alias("mean"))
    keyed = docs.withColumn(digest, name(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(sums, F.col(digest) == F.col("of"), "left").select(*docs.columns, F.coalesce("mean", F.lit(0.0)).alias(into))


@dataclass
class Model:
    """Ratios and the logistic curve; without rows of both classes, everything scores 0."""

    ratios: Ratios | None
    slope: float
    level: float

    def score(self, texts: list[str]) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(texts))
        index = self.ratios.index
        if index is None:
            keys = np.unique(grams(texts)[0])
            asked = self.ratios.table.sparkSession.createDataFrame(pd.DataFrame({"gram": np.union1d(keys, keys | NEW)}))
            index = indexed(self.ratios.table.join(F.broadcast(asked), "gram", "left_semi"))
        return 1 / (1 + np.exp(-np.clip(self.slope * means(texts, index) + self.level, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and level of a logistic curve by Newton's method; the weak ridge keeps separable data finite."""
    middle, spread = x.mean(), x.std() or 1.0
    z, w = np.column_stack([(x - middle) / spread, np.ones(len(x))]), np.zeros(2)
    pull = np.diag([ridge, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull, z.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, broadcast_grams: int = BROADCAST, curve_rows: int = 4000) -> Model:
    """Learn from the rows of ``docs`` with a label whose CRC-32 of the id is not divisible by ``folds``.

    Counts cover all of them and stay in Spark. A table of at most ``broadcast_grams`` ratios is broadcast; a larger one is
    joined by key. The curve takes ``curve_rows`` rows of each class, those with the least hash. A document with several
    labels is toxic if one says so.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max("toxic").alias("toxic"))
    crc = crc_of_id(F.col(key))
    plain = docs.where(crc % folds != 0).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.floor(crc / folds) % 2).cast("int").alias("half"))
    rows = with_small(plain, marks, F.col("id") == F.col("k")).select("id", "text", "half", F.col("toxic").cast("int").alias("toxic"))
    counts = materialise(gram_counts(rows.select("text", (F.col("half") * 2 + F.col("toxic")).alias("part"))), "toxicity-counts")
    seen = counts.agg(F.max(F.col("c0") + F.col("c2")).alias("o"), F.max(F.col("c1") + F.col("c3")).alias("t")).first()
    if not seen.o or not seen.t:
        return Model(None, 0.0, 0.0)
    table = materialise(ratio_table(counts), "toxicity-ratios")
    of = lambda m: table.where(F.col("model") == m).drop("model")
    # The halves only value the sample, so their tables are joined with its words and never reach the driver.
    sample = _sampled(rows, [Ratios(of(m), None) for m in range(2)], curve_rows)
    slope, level = logistic(sample["x"].to_numpy(float), sample["toxic"].to_numpy(float))
    # The sample has the classes in other shares than the labelled rows; the level takes their odds back.
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    drawn = sample["toxic"].value_counts()
    level += float(np.log(n.get(1, 1) / n.get(0, 1)) - np.log(drawn.get(1, 1) / drawn.get(0, 1)))
    return Model(Ratios.of(of(2), broadcast_grams), slope, level)


def _sampled(rows: DataFrame, halves: list[Ratios], most: int) -> pd.DataFrame:
    """``x, toxic`` of the ``most`` rows of either class with the least hash; ``x`` is the value by the other half's counts."""
    order = F.xxhash64("id")
    upto = [rows.where(F.col("toxic") == k).select(order.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0] for k in (0, 1)]
    chosen = rows.where(order <= F.when(F.col("toxic") == 1, F.lit(upto[1])).otherwise(F.lit(upto[0])))
    parts = [halves[1 - half].add_means(chosen.where(F.col("half") == half).select("text", "toxic"), "text", "x") for half in (0, 1)]
    return parts[0].unionByName(parts[1]).select("x", "toxic").toPandas()


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic as ``into``. A null text is empty; every row is scored on its own."""
    name, = fresh(docs, into)
    if model.ratios is None:
        return docs.withColumn(name, F.lit(0.0))
    line = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), model.slope * F.col(name) + model.level))
    return model.ratios.add_means(docs, text, name).withColumn(name, 1 / (1 + F.exp(-line)))
