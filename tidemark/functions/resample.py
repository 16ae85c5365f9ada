"""Deterministic draws: the same in every engine, under every partitioning and after every retry."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, functions as F

BITS = 28


def random_bits(*parts: Column) -> Column:
    """The first 28 bits of the MD5 of the parts, as a BIGINT."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def draw(n: Column, *parts: Column) -> Column:
    """An integer in ``[0, n)`` that depends only on the parts."""
    return F.shiftright(random_bits(*parts) * n.cast("bigint"), BITS)


def bits_of(digest: bytes) -> int:
    """The draw of an MD5 digest: :func:`random_bits` on Python's side."""
    return int.from_bytes(digest[:4], "big") >> (32 - BITS)


@functools.lru_cache(maxsize=4)
def bits_table(seed: int, rows: int, columns: int) -> np.ndarray:
    """Draws for (seed, row from 1, column from 0), made once per worker."""
    return np.array([[bits_of(hashlib.md5(f"{seed}|{b}|{c}".encode()).digest()) for c in range(columns)] for b in range(1, rows + 1)], np.int64).reshape(rows, columns)


def random_bits_sql(*parts: str) -> str:
    """The same as SQL text."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, {BITS // 4}) AS BIGINT)"


def draw_sql(n: str, *parts: str) -> str:
    return f"(({random_bits_sql(*parts)} * ({n})) >> {BITS})"
