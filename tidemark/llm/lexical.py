"""Ranked lexical search over a length-stratified index.

The index is built in one scan of the texts and without a shuffle: a task gathers documents into shards of bounded size, and
each shard is an inverted index of its own with its dictionary, the document frequencies of its terms, the lengths of its
documents and postings ordered by term, length and falling count. Collection figures (documents, words, document frequencies
of the terms asked for) are sums over shards.

The normaliser ``m`` of a document depends on its length and on those figures only. A search joins neighbouring lengths of
equal ``m`` to a stratum and orders its postings by count within (term, stratum), so an impact is computed once per (term,
stratum, count). The first count of a run is the greatest, hence a stratum's bound for an item is the sum of the impacts of
its runs' first counts. Strata are visited by falling bound until the bound is below the item's k-th score. A document lies in
one stratum, so its score is whole once its stratum is visited.

Shards are large rows: each is written as a row group of its own and handed to Python alone, so what a task holds does not grow
with the number of shards in a file. Shards stay where they are. Items travel in rounds of bounded size; in each round some pilot shards give every item a k-th
score that the other shards start from, and a task carries the k-th score on from shard to shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.columns import with_small
from tidemark.llm.words import numbered, numbering, ranges
from tidemark.session import materialise

#: What a term consists of; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on lower-cased UTF-8 bytes, where every byte of a character beyond ASCII is above 0x7F.
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and documents of a shard, terms of the items of a round, and one pilot shard in how many.
SHARD_WORDS, SHARD_DOCS, ROUND_TERMS, PILOT = 1 << 20, 1 << 14, 1 << 18, 16
#: One shard at a time: in the Parquet writer and reader, and in a batch for Python. Texts come in batches of some megabytes.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ALONE, ONE_A_BATCH, TEXTS_A_BATCH = {"parquet.block.row.count.limit": "1"}, {BATCH: "1"}, {BATCH: "1024"}
SHARD_ARRAYS = ("doc_ids", "lengths", "starts", "posting_docs", "posting_tfs")
SHARD_SCHEMA = "shard long, docs long, words long, terms array<string>, dfs array<long>, doc_ids binary, lengths binary, starts binary, posting_docs binary, posting_tfs binary"


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), 1)


def _shard(number: int, ids: list[int], rows: list[np.ndarray], numbers: dict) -> dict:
    """One shard row from the words of its documents by local term number."""
    lengths = np.array([len(r) for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows)), lengths)
    pair, tf = np.unique(np.concatenate(rows).astype(np.int64) * len(rows) + doc, return_counts=True)
    term, doc = np.divmod(pair, len(rows))
    order = np.lexsort((-tf, lengths[doc], term))
    starts = np.searchsorted(term, np.arange(len(numbers) + 1))
    return {
        "shard": number,
        "docs": len(rows),
        "words": int(lengths.sum()),
        "terms": [t.decode() for t in numbers],
        "dfs": np.diff(starts),
        "doc_ids": np.array(ids, np.int64).tobytes(),
        "lengths": lengths.tobytes(),
        "starts": starts.astype(np.int64).tobytes(),
        "posting_docs": doc[order].astype(np.int32).tobytes(),
        "posting_tfs": tf[order].astype(np.int32).tobytes(),
    }


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The shards over all of ``docs``, see :data:`SHARD_SCHEMA`.

    Every row with an id and at least one term is a document of its own, repeated rows too; rows with a null id, and null or
    wordless texts, are no documents. Texts are read whole in slices; a text beyond the size of a shard fills one alone.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, rows, numbers, held = [], [], numbering(), 0

        def flush() -> pa.RecordBatch:
            frame = pd.DataFrame([_shard(number, ids, rows, numbers)])
            return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

        for batch in batches:
            for one, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = numbered(raw.as_buffer().to_pybytes().lower(), TERM_BYTES, TERM_BYTES, numbers)
                if not len(row):
                    continue
                ids.append(one)
                rows.append(row)
                held += len(row)
                if held >= shard_words or len(rows) >= shard_docs:
                    yield flush()
                    ids, rows, numbers, held, number = [], [], numbering(), 0, number + 1
        if rows:
            yield flush()

    schema = pa.schema(
        [("shard", pa.int64()), ("docs", pa.int64()), ("words", pa.int64()), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64()))]
        + [(name, pa.binary()) for name in SHARD_ARRAYS]
    )
    kept = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return materialise(kept.mapInArrow(build, SHARD_SCHEMA), "lexical-shards", conf=TEXTS_A_BATCH, options=ALONE)


@dataclass
class Strata:
    """The postings of one shard for the terms asked for, by term, stratum and falling count.

    ``runs`` are the (term, stratum) runs: of term ``t`` those from ``run_of[t]`` to ``run_of[t + 1]``.
    """

    doc_ids: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    strata: int
    run_of: np.ndarray
    run_stratum: np.ndarray
    run_first: np.ndarray
    run_size: np.ndarray

    @classmethod
    def of(cls, row, local: np.ndarray, documents: int, words: int) -> Strata:
        """``local`` are the shard's numbers of the terms asked for, -1 where it lacks one."""
        whole = lambda raw, kind=np.int64: np.frombuffer(raw, kind)
        lengths, starts = whole(row.lengths), whole(row.starts)
        # Few lengths are distinct; Python's integers do not overflow on the product.
        length, at = np.unique(lengths, return_inverse=True)
        m, of_length = np.unique(np.array([25 + 75 * n * documents // words for n in length.tolist()], np.int64), return_inverse=True)
        stratum = of_length[at]
        first = np.where(local >= 0, starts[np.maximum(local, 0)], 0)
        size = np.where(local >= 0, starts[np.maximum(local, 0) + 1] - first, 0)
        take = ranges(first, size)
        term = np.repeat(np.arange(len(local)), size)
        docs, tf = whole(row.posting_docs, np.int32)[take], whole(row.posting_tfs, np.int32)[take].astype(np.int64)
        order = np.lexsort((-tf, stratum[docs], term))
        term, docs, tf = term[order], docs[order], tf[order]
        run = term * len(m) + stratum[docs]
        new_run = np.diff(run, prepend=-1) != 0
        level = np.flatnonzero(new_run | (np.diff(tf, prepend=-1) != 0))
        # One impact per (term, stratum, count), spread over the documents that share it.
        t = tf[level]
        impact = 1_000_000_000 * t // (1000 * t + 8 * m[stratum[docs[level]]])
        impacts = np.repeat(impact, np.diff(np.append(level, len(docs))))
        run_first = np.flatnonzero(new_run)
        run_of = np.searchsorted(run[run_first] // len(m), np.arange(len(local) + 1))
        return cls(whole(row.doc_ids), docs, impacts, len(m), run_of, run[run_first] % len(m), run_first, np.diff(np.append(run_first, len(docs))))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of what can be among the ``k`` best given that ``least`` is reached, and how many strata were visited.

        ``total`` is a zeroed array of one number per document, zeroed again on return.
        """
        size = self.run_of[terms + 1] - self.run_of[terms]
        runs = ranges(self.run_of[terms], size)
        weight = np.repeat(weights, size)
        where = self.run_stratum[runs]
        # Sums in doubles; the little that is added keeps a bound from being too small.
        bound = np.bincount(where, weight.astype(np.float64) * self.impacts[self.run_first[runs]], self.strata) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        turn = np.full(self.strata, len(order))
        turn[order] = np.arange(len(order))
        by_turn = np.argsort(turn[where], kind="stable")
        runs, weight, turns = runs[by_turn], weight[by_turn], turn[where][by_turn]
        ids, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4
        while at < len(order) and bound[order[at]] >= least:
            # The next strata, twice as many each time, but none whose bound is below the k-th score.
            end = at + int(np.searchsorted(-bound[order[at : at + step]], -float(least), side="right"))
            low, high = np.searchsorted(turns, [at, end])
            part = runs[low:high]
            posting = ranges(self.run_first[part], self.run_size[part])
            docs = self.docs[posting]
            np.add.at(total, docs, self.impacts[posting] * np.repeat(weight[low:high], self.run_size[part]))
            met = np.unique(docs)
            score = total[met]
            total[met] = 0
            good = score >= max(least, 1)
            ids, scores = best(np.append(ids, self.doc_ids[met[good]]), np.append(scores, score[good]), k)
            if len(scores) == k:
                least = max(least, int(scores[-1]))
            at, step = end, step * 2
        return ids, scores, at


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores, equal ones by ascending id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _visit(vocabulary: pa.Array, items: list[tuple[np.ndarray, np.ndarray]], least: np.ndarray, k: int, documents: int, words: int):
    """Search all shards of a task with the items of a round, and give each item's best once at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        kth = least.copy()
        for batch in batches:
            for at in range(batch.num_rows):
                # Terms and postings are read where the batch has them; no Python object is made for a term.
                row = SimpleNamespace(**{name: batch.column(name)[at].as_buffer() for name in SHARD_ARRAYS})
                own = batch.column("terms")[at].values.cast(pa.string())
                local = pc.fill_null(pc.index_in(vocabulary, value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                strata = Strata.of(row, local, documents, words)
                total = np.zeros(len(strata.doc_ids), np.int64)
                for i, (terms, weights) in enumerate(items):
                    ids, scores, _ = strata.search(terms, weights, k, int(kth[i]), total)
                    if len(ids):
                        found[i] = best(np.append(found[i][0], ids), np.append(found[i][1], scores), k)
                        if len(found[i][1]) == k:
                            kth[i] = max(kth[i], found[i][1][-1])
        size = [len(ids) for ids, _ in found]
        if any(size):
            columns = np.repeat(np.arange(len(found)), size), *(np.concatenate(part).astype(np.int64) for part in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc_id", "score"])

    return run


def _asked(items: DataFrame, shards: DataFrame, documents: int, key: str, text: str) -> DataFrame:
    """``item_id, term, weight``: each term of an item that the documents have, with its weight times its occurrences in the item."""
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("item_text")).distinct()
    counted = rows.select("item_id", F.explode(terms_of(F.col("item_text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    counted = materialise(counted, "lexical-items")
    entries = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.dfs").alias("df"))
    wanted = counted.select(F.col("term").alias("asked")).distinct()
    frequency = with_small(entries, wanted, F.col("term") == F.col("asked"), "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents) + 2) / (2 * F.col("df").cast("double") + 1))).cast("bigint")
    return counted.join(frequency, "term").select("item_id", "term", (weight * F.col("times")).alias("weight")).where("weight > 0")


def search(shards: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", round_terms: int = ROUND_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, equal scores by ascending id.

    Terms of an item count as often as it has them. Equal item rows count once; several texts of one item id make one item of
    all their terms. Items with a null id take no part; items without a known term, and all items over an empty index, give no
    rows. The driver holds the terms of one round at a time, ``round_terms`` or those of one item.
    """
    schema = "item_id bigint, rank int, doc_id bigint, score bigint"
    spark = shards.sparkSession
    documents, words = shards.agg(F.sum("docs"), F.sum("words")).first()
    if not documents:
        return spark.createDataFrame([], schema)
    asked = materialise(_asked(items, shards, documents, key, text), "lexical-asked")
    rounds = -(-asked.count() // round_terms)
    found = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    pilot = F.pmod(F.xxhash64("shard"), F.lit(PILOT)) == 0
    for n in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == n).toPandas()
        terms, at = np.unique(part["term"].to_numpy(), return_inverse=True)
        ids, who = np.unique(part["item_id"].to_numpy(np.int64), return_inverse=True)
        order = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[order], np.arange(1, len(ids)))
        lists = list(zip(np.split(at[order], cuts), np.split(part["weight"].to_numpy(np.int64)[order], cuts), strict=True))
        vocabulary = pa.array(terms.tolist(), pa.string())
        numbers = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(ids)), "item_id": ids}), "item long, item_id long")

        def visit(some: DataFrame, least: np.ndarray, label: str) -> DataFrame:
            met = some.select("terms", *SHARD_ARRAYS).mapInArrow(_visit(vocabulary, lists, least, k, documents, words), "item long, doc_id long, score long")  # noqa: B023
            return materialise(met, label, conf=ONE_A_BATCH)

        first = visit(shards.where(pilot), np.zeros(len(ids), np.int64), "lexical-pilot")
        place = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        least = np.zeros(len(ids), np.int64)
        for r in first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("item", "score").collect():
            least[r["item"]] = r["score"]
        both = first.unionByName(visit(shards.where(~pilot), least, "lexical-rest"))
        found = found.unionByName(both.join(F.broadcast(numbers), "item").select("item_id", "doc_id", "score"))
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """:func:`search` over a new :func:`index` of ``docs``."""
    return search(index(docs), items, k)


#: The same rows by scoring every document, for DuckDB.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT * FROM d WHERE len(t) > 0),
c AS (SELECT count(*) AS docs, sum(len(t)) AS words FROM s),
p AS (SELECT row, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, unnest(t) AS term FROM s) GROUP BY ALL),
m AS (SELECT row, CAST(25 + (75 * CAST(len(t) AS HUGEINT) * docs) // words AS BIGINT) AS m FROM s, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(max(docs) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
i AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL))
  GROUP BY ALL),
scored AS (
  SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (row) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
