"""Byte-level BPE: encoding by rounds over length-bucketed padded matrices, decoding by one gather.

A text is split by a pattern, and every distinct piece of a block is one row of a matrix of token ids. In each round every
row merges its leftmost pair of least rank; pairs are looked up in a hash table in bulk, rows are compacted by one gather,
and rows without a pair leave. Rows of similar length share a matrix. Very long pieces, for which a round per merge would be
quadratic, are merged with a heap; it makes the same merges in the same order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashindex import HashIndex
from tidemark.llm.held import kept
from tidemark.llm.pieces import Remembering

#: Pieces of more bytes are merged with a heap.
LONG = 128
NONE = np.iinfo(np.int32).max


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The entries ``flat[starts[i] : starts[i] + sizes[i]]`` of all ``ids`` behind each other."""
    n = sizes[ids]
    ends = np.cumsum(n)
    where = np.repeat(starts[ids] - (ends - n), n)
    where += np.arange(len(where))
    return flat[where]


class Bpe:
    """A vocabulary of ranks, where a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs_of = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs_of[left << 32 | right] = rank
        self.pairs = HashIndex(np.fromiter(self.pairs_of, np.int64, len(self.pairs_of)), np.fromiter(self.pairs_of.values(), np.int32, len(self.pairs_of)))
        top = max(ranks.values()) + 1
        parts, names = [b""] * top, [b""] * top
        for token, rank in ranks.items():
            parts[rank], names[rank] = token, b"%d," % rank
        self.bytes_of, self.decimal_of = self._table(parts), self._table(names)
        self.texts = Remembering(pattern, lambda pieces: [ids.tobytes() for ids in self.merge([p.encode("utf-8", "surrogatepass") for p in pieces])])

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(parts), np.uint8)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of every piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONG:
                out[i] = self._heap(piece)
            elif piece:
                groups.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for rows in groups.values():
            for i, ids in zip(rows, self._rounds([pieces[i] for i in rows]), strict=True):
                out[i] = ids
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where(right >= 0, left.astype(np.int64) << 32 | right, -2)
        return np.where(keys >= 0, self.pairs.get(np.maximum(keys, 0).ravel(), NONE).reshape(keys.shape), NONE)

    def _rounds(self, pieces: list[bytes]) -> list[np.ndarray]:
        wide = max(map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(len(pieces), wide)
        # One column of padding more, so that a shift always has something to draw in.
        ids = np.full((len(pieces), wide + 1), -1, np.int32)
        ids[:, :wide] = np.where(np.arange(wide) < sizes[:, None], self.byte_ids[raw], -1)
        ranks = np.full((len(pieces), wide + 1), NONE, np.int32)
        ranks[:, :wide] = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        live, done = np.arange(len(pieces)), [np.zeros(0, np.int32)] * len(pieces)
        columns = np.arange(wide)
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            over = best == NONE
            for row in np.flatnonzero(over):
                done[live[row]] = ids[row, : sizes[row]].copy()
            keep = ~over
            live, ids, ranks, sizes, at, best = live[keep], ids[keep], ranks[keep], sizes[keep], at[keep], best[keep]
            if not len(live):
                break
            row = np.arange(len(live))
            # The merged token stands at the pair's place; everything behind it moves up by one.
            draw = columns + (columns > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, draw, 1)
            ids[:, -1] = -1
            ids[row, at] = best
            ranks[:, :-1] = np.take_along_axis(ranks, draw, 1)
            ranks[:, -1] = NONE
            sizes -= 1
            ranks[row, at] = self._pair_ranks(best, ids[row, at + 1])
            behind = at > 0
            ranks[row[behind], at[behind] - 1] = self._pair_ranks(ids[row[behind], at[behind] - 1], best[behind])
            if (used := int(sizes.max())) < ids.shape[1] - 1:
                ids, ranks, columns = ids[:, : used + 1], ranks[:, : used + 1], np.arange(used)
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.byte_ids[b]) for b in piece]
        n, pair = len(ids), self.pairs_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := pair(rank << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if before[i] >= 0 and (r := pair(ids[before[i]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of every text, without special tokens."""
        for raw in self.texts.encode(texts):
            yield np.frombuffer(raw, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for."""
        return gather(ids, *self.bytes_of).tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, joined by commas."""
        return gather(ids, *self.decimal_of).tobytes()[:-1]


def loaded(path: str, pattern: str) -> Bpe:
    """The tokenizer of a rank file; a worker reads it once, and keeps it until another operator's task starts there."""
    return kept("bpe", (path, pattern), lambda: _read(path, pattern))


def _read(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return Bpe(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the array column ``into``. A null text is empty; every row is kept, and each stands for itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for batch in batches:
            batch[into] = list(bpe.encode(batch[text].fillna("").tolist()))
            yield batch

    return docs.mapInPandas(run, docs.drop(into).withColumn(into, F.lit(None).cast("array<int>")).schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``into``, the bytes of the ids in ``ids``; null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for batch in batches:
            batch[into] = [None if x is None else bpe.decode(np.asarray(x, np.int64)) for x in batch[ids]]
            yield batch

    return docs.mapInPandas(run, docs.drop(into).withColumn(into, F.lit(None).cast("binary")).schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key, n_tokens, ids_sha256, decoded_sha256``: encodes and decodes in one pass, so no id leaves its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for batch in batches:
            rows = []
            for ids in bpe.encode(batch["t"].tolist()):
                rows.append((len(ids), hashlib.sha256(bpe.decimals(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, key, batch["k"].values)
            yield out

    plain = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = plain.mapInPandas(run, f"`{key}` string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return found.withColumn(key, F.col(f"`{key}`").cast(docs.schema[key].dataType))
