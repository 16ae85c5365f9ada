"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: ASCII white space, which separates words.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores appended until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words; null has none. Counts the ends of runs, so no word is built."""
    flat = F.concat(F.translate(text, SPACE, " " * len(SPACE)), F.lit(" "))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    # Every run of spaces but a leading one ends a word; collapse runs by counting pairs of neighbours.
    packed = F.regexp_replace(flat, " +", " ")
    return F.coalesce(
        F.when(spaces == F.length(flat), F.lit(0)).otherwise(
            F.length(packed) - F.length(F.replace(packed, F.lit(" "), F.lit(""))) - F.when(flat.startswith(" "), 1).otherwise(0)
        ),
        F.lit(0),
    ).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; null counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8"))


def id_crc(value: object) -> int:
    """The same on a Python value."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offset of each text with the end appended."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def blocks(sizes: list[int], most: int) -> list[slice]:
    """Consecutive slices of about ``most`` in total; a larger item stands alone, and none is left out."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append(slice(start, i))
            start, total = i, 0
        total += n
    if len(sizes) > start:
        out.append(slice(start, len(sizes)))
    return out


def with_small(big: DataFrame, small: DataFrame, on: Column, how: str = "inner", most: int = 500_000) -> DataFrame:
    """Join ``big`` with ``small``, which is broadcast only if it has at most ``most`` rows; beyond, both sides are shuffled."""
    return big.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)
