"""Exact top-k by inner product: branch and bound over ball trees, one tree per shard of the candidates.

Candidates are dealt into shards of bounded size by a hash, and a ball tree is built over each shard once. Queries are dealt
into blocks. Every block visits every shard by an equi-join on (shard, block), so no side is broadcast and no task holds more
than one tree and one block. A visit takes nodes in the order of their bound ``q . centre + |q| radius`` and stops when the best
open bound falls below the query's k-th score. That score is shared: a first pass over one shard gives every query a k-th
score that already holds when it enters the other trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import materialise

#: Candidates of a shard, queries of a block, and candidates of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 1024, 128
NEVER = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``id, v, dim`` with each component as ``floor(scale * x)``; rows with a null id or a null, empty or non-finite vector leave."""
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False)))
    return kept.select(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"), F.size(vector).alias("dim"))


@dataclass
class BallTree:
    """Rows in leaf order; node ``n`` covers ``first[n] : last[n]`` and has children ``2 n + 1`` and ``2 n + 2``."""

    ids: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Halve each node at the median of the direction between two far points; halves are by count, so copies do no harm."""
        order, real = np.arange(len(ids)), rows.astype(np.float64)
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        count = 2 ** (depth + 1) - 1
        first, last = np.zeros(count, np.int64), np.zeros(count, np.int64)
        centre, radius = np.zeros((count, rows.shape[1])), np.zeros(count)
        last[0] = len(ids)
        for n in range(count):
            own = order[first[n] : last[n]]
            if len(own):
                centre[n] = real[own].mean(0)
                away = ((real[own] - centre[n]) ** 2).sum(1)
                # A little is added for rounding, so that a bound is never too small.
                radius[n] = np.sqrt(away.max()) * (1 + 1e-9) + 1e-6
            if 2 * n + 2 < count:
                half = len(own) // 2
                if half:
                    a = real[own[away.argmax()]]
                    b = real[own[((real[own] - a) ** 2).sum(1).argmax()]]
                    order[first[n] : last[n]] = own[np.argpartition(real[own] @ (b - a), half)]
                first[2 * n + 1], last[2 * n + 1] = first[n], first[n] + half
                first[2 * n + 2], last[2 * n + 2] = first[n] + half, last[n]
        return cls(ids[order], rows[order], first, last, centre, radius)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of queries, ids and scores of what can be among a query's ``k`` best, given that ``least`` is already reached.

        All queries advance together: each round every open query takes its best node, nodes are handled for all queries that
        chose them at once, and a query closes when its best open bound is below its k-th score.
        """
        real, size = queries.astype(np.float64), np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        exact = size.max(initial=0) * np.sqrt((self.rows.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2**52
        rows = self.rows.astype(np.float64) if exact else self.rows
        asked = real if exact else queries
        bound = np.full((len(queries), len(self.radius)), -np.inf)
        bound[:, 0] = np.inf
        kth = least.copy()
        found = [np.zeros(0, np.int64)] * 3
        open_ = np.arange(len(queries))
        while len(open_):
            node = bound[open_].argmax(1)
            top = bound[open_, node]
            # Equal bounds stay open: a tie may go to a smaller id.
            alive = (top > -np.inf) & (top >= kth[open_])
            open_, node = open_[alive], node[alive]
            bound[open_, node] = -np.inf
            fresh = []
            for n in np.unique(node):
                who = open_[node == n]
                if 2 * n + 2 < len(self.radius):
                    for child in (2 * n + 1, 2 * n + 2):
                        if self.last[child] > self.first[child]:
                            bound[who, child] = real[who] @ self.centre[child] + size[who] * self.radius[child] + 1
                    continue
                part = slice(self.first[n], self.last[n])
                score = asked[who] @ rows[part].T
                q, c = np.nonzero((score >= kth[who][:, None]) & (self.ids[part][None, :] != query_ids[who][:, None]))
                fresh.append((who[q], self.ids[part][c], score[q, c].astype(np.int64)))
            if fresh:
                found = [np.concatenate([old, *new]) for old, new in zip(found, zip(*fresh, strict=True), strict=True)]
                found, full = best_of(*found, k)
                kth[full[0]] = np.maximum(kth[full[0]], full[1])
        return tuple(found)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The ``k`` best ids of each query with their best scores, ties to smaller ids, and the k-th score of the queries that have ``k``."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    # An id with several vectors takes one place, with the best of them.
    once = np.ones(len(query), bool)
    once[1:] = (np.diff(query) != 0) | (np.diff(ids) != 0)
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    head = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    kept, kth = rank < k, rank == k - 1
    return [query[kept], ids[kept], score[kept]], (query[kth], score[kth])


def _packed(rows: DataFrame, name: str, size: int, tree: bool) -> DataFrame:
    """Rows gathered into groups of about ``size`` per dimension, one row each: ``dim, <name>, ids, data`` (and the tree)."""
    counts = rows.groupBy("dim").count().collect()
    parts = F.lit(1)
    for r in counts:
        parts = F.when(F.col("dim") == r["dim"], F.lit(max(1, -(-r["count"] // size)))).otherwise(parts)
    # Equal rows are gone by now and the vector is dealt by too, so a group stays near its size even if one id has most rows.
    keyed = rows.withColumn(name, F.pmod(F.xxhash64("id", "v", F.lit(name)), parts).cast("int"))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        ids, data = frame["id"].to_numpy(np.int64), np.stack(frame["v"].to_numpy()).astype(np.int64)
        out = {"dim": [int(frame["dim"].iloc[0])], name: [int(frame[name].iloc[0])]}
        if tree:
            t = BallTree.build(ids, data)
            ids, data = t.ids, t.rows
            out |= {"first": [t.first.tobytes()], "last": [t.last.tobytes()], "centre": [t.centre.tobytes()], "radius": [t.radius.tobytes()]}
        return pd.DataFrame(out | {"ids": [ids.tobytes()], "data": [data.tobytes()]})

    schema = f"dim int, {name} int" + (", first binary, last binary, centre binary, radius binary" if tree else "") + ", ids binary, data binary"
    return keyed.groupBy("dim", name).applyInPandas(gather, schema)


def _visit(k: int):
    """Search each tree of a batch with the block beside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                wide = lambda raw: np.frombuffer(raw, np.int64).reshape(-1, r.dim)
                tree = BallTree(np.frombuffer(r.ids, np.int64), wide(r.data), np.frombuffer(r.first, np.int64), np.frombuffer(r.last, np.int64), np.frombuffer(r.centre, np.float64).reshape(-1, r.dim), np.frombuffer(r.radius, np.float64))
                query_ids = np.frombuffer(r.q_ids, np.int64)
                query, ids, score = tree.search(query_ids, wide(r.q_data), k, np.frombuffer(r.least, np.int64))
                yield pd.DataFrame({"query_id": query_ids[query], "vec_id": ids, "score": score, "dim": r.dim, "block": r.block})

    return run


def topk(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row for which ``is_query(id)`` holds, its ``k`` best other rows.

    Scores are inner products of the quantised vectors and fit into 64 bits; ties go to the smaller id. Only vectors of equal
    length are compared. Ids name rows: rows of the query's own id are not its candidates, exact repetitions count once, and a
    query id with several vectors gets the best over all of them, once per candidate id.
    """
    rows = materialise(quantised(vectors, key, vector, scale).distinct(), "topk-rows")
    trees = materialise(_packed(rows, "shard", shard_rows, True), "topk-trees")
    blocks = materialise(_packed(rows.where(is_query(F.col("id"))), "block", block_rows, False), "topk-blocks").select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    shards = trees.groupBy("dim").agg((F.max("shard") + 1).alias("shards"))
    found_schema = "query_id bigint, vec_id bigint, score bigint, dim int, block int"

    def unknown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["least"] = [np.full(len(raw) // 8, NEVER, np.int64).tobytes() for raw in batch["q_ids"]]
            yield batch

    with_least = "dim int, block int, q_ids binary, q_data binary, least binary"
    pilots = blocks.mapInPandas(unknown, with_least).join(shards, "dim").withColumn("shard", F.pmod(F.col("block"), F.col("shards"))).drop("shards")
    first = materialise(trees.join(pilots, ["dim", "shard"]).repartition("dim", "block").mapInPandas(_visit(k), found_schema), "topk-first")
    # The k-th score of the pilot shard over distinct ids, per query id of its block.
    met = first.groupBy("dim", "block", "query_id", "vec_id").agg(F.max("score").alias("score"))
    places = Window.partitionBy("dim", "block", "query_id").orderBy(F.desc("score"), "vec_id")
    kth = met.withColumn("place", F.row_number().over(places)).where(F.col("place") == k).withColumnRenamed("score", "kth")
    known = kth.groupBy("dim", "block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "kth"))).alias("known"))

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["least"] = [
                np.array([dict(known or {}).get(i, NEVER) for i in np.frombuffer(raw, np.int64).tolist()], np.int64).tobytes() for raw, known in zip(batch["q_ids"], batch["known"], strict=True)
            ]
            yield batch.drop(columns="known")

    ready = blocks.join(known, ["dim", "block"], "left").mapInPandas(shared, with_least).join(shards, "dim")
    visits = ready.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    copies = trees.join(blocks.groupBy("dim").agg((F.max("block") + 1).alias("blocks")), "dim")
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = copies.join(visits, ["dim", "shard", "block"])
    best = pairs.mapInPandas(_visit(k), found_schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by comparing everything, for DuckDB.
ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0),
best AS (SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
