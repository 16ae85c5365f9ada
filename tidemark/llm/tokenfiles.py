"""Token ids in binary files: one zstandard frame per document, then a seek table with a checksum for every frame.

Layout of a file, all numbers little-endian::

    frame 0 .. frame n-1        each an independent zstandard frame: the document's ids as unsigned 32-bit integers
    skippable frame 0x184D2A50  a zstandard frame of n int64 document ids and n bytes, 1 where the id is null
    skippable frame 0x184D2A5E  the seek table: n times (compressed size, decompressed size, checksum), then the footer
                                (number of frames, descriptor 0x80, 0x8F92EAB1)

This is the public seekable format, so any zstandard tool decompresses the ids. The checksum is the low half of XXH64 of the
decompressed bytes. A reader takes the footer, the table and the ids, and then decompresses only the frames asked for. The
files of a corpus are in ascending order of document id, within a file and from file to file; null ids come first.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bytefiles import AtomicFile, located
from tidemark.llm.held import kept
from tidemark.llm.pieces import Remembering

#: Fixed values of the file format.
SEEK_MAGIC, IDS_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: New pieces that the library encodes in one call.
TOGETHER = 1000


@functools.lru_cache(maxsize=2)
def _library(path: str):
    # A task has one core: threads of the library beside it would only cost time and memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(path: str, pattern: str) -> Remembering:
    """Ids of whole texts by the tokenizers library as little-endian unsigned 32-bit integers.

    A byte-level tokenizer splits a text by ``pattern`` and encodes the pieces one by one, so a text's ids are those of its
    pieces in order. Pieces recur, so the library sees each distinct one once; the encoder and what it remembers serve all tasks
    of a worker process until another operator's task starts there. A literal added token in a text becomes its own id, as the
    library has it.
    """
    return kept("tokenfiles", (path, pattern), lambda: _encoder(path, pattern))


def _encoder(path: str, pattern: str) -> Remembering:
    library = _library(path)
    added = library.get_added_tokens_decoder().values()
    if any(token.lstrip or token.rstrip or token.single_word for token in added):
        raise ValueError(f"{path} has added tokens that depend on their neighbours")
    # A byte-level token has one character for each byte that it stands for.
    vocabulary = library.get_vocab()
    width = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
    width[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def encode(pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        # Words with a space before them stay pieces of their own when they follow each other, so one call takes them all.
        spaced = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        for at in range(0, len(spaced), TOGETHER):
            group = spaced[at : at + TOGETHER]
            words = [pieces[i] for i in group]
            found, = library.encode_batch_fast(["".join(words)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            # The call that keeps no offsets is quicker; the bytes of the tokens tell where a word ends.
            upto, ends = np.cumsum(width[ids]), np.cumsum([len(word.encode()) for word in words])
            cuts = np.searchsorted(upto, ends) + 1
            if len(ids) != cuts[-1] or (upto[cuts - 1] != ends).any():
                continue
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            for i, start, end in zip(group, [0, *cuts[:-1]], cuts, strict=True):
                out[i] = raw[start:end]
        rest = [i for i in range(len(pieces)) if not out[i]]
        for i, found in zip(rest, library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(found.ids)}I", *found.ids)
        return out

    return Remembering(pattern, encode, [token.content for token in added])


def write_file(path: str, documents: Iterator[tuple[int | None, bytes]], level: int = 3) -> tuple[int, int]:
    """Write ``(document id, ids)`` in the given order; the numbers of documents and of ids. Only the index is kept in memory."""
    press = zstandard.ZstdCompressor(level=level)
    keys, nulls, table, total = [], bytearray(), bytearray(), 0
    with AtomicFile(path) as out:
        for key, raw in documents:
            frame = press.compress(raw)
            out.write(frame)
            table += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
            keys.append(key or 0)
            nulls.append(key is None)
            total += len(raw) // 4
        index = press.compress(np.array(keys, "<i8").tobytes() + bytes(nulls))
        out.write(struct.pack("<II", IDS_MAGIC, len(index)) + index)
        out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + bytes(table) + struct.pack("<IBI", len(keys), 0x80, FOOTER_MAGIC))
    return len(keys), total


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        system, inner = located(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{path} has no seek table")
        start = size - 9 - 12 * count - 8
        head, length = struct.unpack("<II", self.file.read_at(8, start))
        if head != SEEK_MAGIC or length != 12 * count + 9:
            raise ValueError(f"{path} has a broken seek table")
        self.table = np.frombuffer(self.file.read_at(12 * count, start + 8), "<u4").reshape(count, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        head, length = struct.unpack("<II", self.file.read_at(8, int(self.offsets[-1])))
        if head != IDS_MAGIC:
            raise ValueError(f"{path} has no document ids")
        self.unpress = zstandard.ZstdDecompressor()
        index = self.unpress.decompress(self.file.read_at(length, int(self.offsets[-1]) + 8))
        keys, nulls = np.frombuffer(index, "<i8", count), index[8 * count :]
        self.keys: list[int | None] = [None if null else int(key) for key, null in zip(keys, nulls, strict=True)]

    def __len__(self) -> int:
        return len(self.keys)

    def read(self, i: int) -> np.ndarray:
        """The ids of the i-th document; other frames stay untouched."""
        packed, plain, check = (int(x) for x in self.table[i])
        raw = self.unpress.decompress(self.file.read_at(packed, int(self.offsets[i])), max_output_size=plain)
        if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u4")


def write(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise ``docs`` into files below ``folder``; one row per file: ``path, documents, tokens, start``.

    ``start`` is the number of ids in the files before. A null text counts as empty; rows of equal id follow each other; an
    empty table writes no file. Rows are dealt by ranges of the id, so that file order is id order; a file's name comes from
    its range, and a retried task writes it again whole.
    """
    spark = docs.sparkSession

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ours, end = encoder(tokenizer, pattern), b"" if end_id is None else struct.pack("<I", end_id)
        shard = TaskContext.get().partitionId()
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return

        def documents() -> Iterator[tuple[int | None, bytes]]:
            batch: pd.DataFrame | None = first
            while batch is not None:
                keys = [None if pd.isna(k) else int(k) for k in batch["k"].tolist()]
                yield from zip(keys, (ids + end for ids in ours.encode(batch["t"].tolist())), strict=True)
                batch = next(batches, None)

        path = f"{folder}/ids-{shard:06d}.zst"
        count, total = write_file(path, documents())
        yield pd.DataFrame({"shard": [shard], "path": [path], "documents": [count], "tokens": [total]})

    plain = docs.select(F.col(key).cast("bigint").cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(key).alias("by"))
    dealt = plain.repartitionByRange(F.col("by").asc_nulls_first()).sortWithinPartitions(F.col("by").asc_nulls_first()).select("k", "t")
    # One row per file comes to the driver, as for any table manifest: running totals over files need no shuffle.
    manifest = sorted(dealt.mapInPandas(files, "shard int, path string, documents bigint, tokens bigint").collect())
    rows, start = [], 0
    for _, path, count, total in manifest:
        rows.append((path, count, total, start))
        start += total
    return spark.createDataFrame(rows, "path string, documents bigint, tokens bigint, start bigint")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files of :func:`write`: ``doc_id, start, ids`` as little-endian bytes."""
    return _over(manifest, "doc_id bigint, start bigint, ids binary", lambda ids: {"ids": ids.tobytes()})


def checksums(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The same with ``n_tokens, ids_crc32`` in place of the ids."""
    return _over(manifest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})


def _over(manifest: DataFrame, schema: str, row, rows: int = 500) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"].tolist(), strict=True):
                file, found = TokenFile(path), []
                for i, key in enumerate(file.keys):
                    ids = file.read(i)
                    found.append({"doc_id": key, "start": start, **row(ids)})
                    start += len(ids)
                    if len(found) == rows or i == len(file) - 1:
                        yield pd.DataFrame(found).astype({"doc_id": "Int64"})
                        found = []

    files = manifest.count()
    # One file per task: a file is the unit of reading.
    return manifest.repartition(max(1, files), "path").mapInPandas(scan, schema) if files else manifest.sparkSession.createDataFrame([], schema)


def take(path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of some documents of one file."""
    file = TokenFile(path)
    wanted = set(doc_ids)
    return {key: file.read(i) for i, key in enumerate(file.keys) if key in wanted}
