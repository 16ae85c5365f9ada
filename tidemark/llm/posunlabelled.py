"""A quality classifier from trusted positives and unlabelled text.

Labels name good documents only; everything else is unlabelled, good and bad mixed. The share of good documents in the
unlabelled text is estimated first: a plain classifier of positives against unlabelled text ranks held-back rows, and the prior
is the least share of unlabelled over positive rows above any cut, with a margin for chance (the best bin). A small network then
minimises the non-negative unbiased risk: with prior ``p``, ``p R+(positives)`` plus the part of the unlabelled risk that
positives do not explain, ``R-(unlabelled) - p R-(positives)``. Where that part falls below zero, which a true risk cannot, the
step goes back up instead of fitting noise. The loss is logistic, so the score is an estimate of the probability of being good.

A text is described by the shares of neighbouring kinds of bytes and by counts of its words: lengths, repetitions, capitals.
Nothing in it names a language, a source or an id. Fitting is bounded by ``positives`` and ``unlabelled`` rows, chosen by a hash
of the id; all rows are scored, over their whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.columns import crc_of_id, fresh
from tidemark.llm.words import numbered, numbering

WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
#: Kinds of bytes; bytes that no entry names are of the last kind but one, those beyond ASCII of the last.
KINDS = [b" \t\r\x0b\x0c", b"\n", b"0123456789", bytes(range(97, 123)), bytes(range(65, 91)), b".", b",", b"!?", b";:", b"'\"`", b"()[]{}", b"|", b"#*$%&<>@~^=+_\\", b"-/"]
SIDE = len(KINDS) + 2
#: Rows to fit on, hidden units, steps, rows of either side per step, step size, weight decay.
POSITIVES, UNLABELLED, HIDDEN, STEPS, BATCH, RATE, DECAY = 6000, 12000, 24, 1200, 256, 3e-3, 1e-3
#: Bytes whose kinds are paired at once.
SLICE = 1 << 22


def _kinds() -> np.ndarray:
    table = np.full(256, SIDE - 2, np.uint8)
    table[128:] = SIDE - 1
    for kind, members in enumerate(KINDS):
        table[np.frombuffer(members, np.uint8)] = kind
    return table


KIND_OF = _kinds()
COUNTS = ["words", "bytes", "mean_word", "distinct", "commonest", "doubled", "repeated", "short", "long", "lines"]
WIDTH = SIDE * SIDE + len(COUNTS)


def features(raw: bytes) -> np.ndarray:
    """The description of one text; an empty one is all zeros.

    First the root of the share of each pair of kinds among neighbouring bytes, then the numbers of :data:`COUNTS`.
    """
    out = np.zeros(WIDTH)
    pairs = np.zeros(SIDE * SIDE, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - 1, SLICE):
        kinds = KIND_OF[data[at : at + SLICE + 1]].astype(np.int16)
        pairs += np.bincount(kinds[:-1] * SIDE + kinds[1:], minlength=SIDE * SIDE)
    out[: SIDE * SIDE] = np.sqrt(pairs / max(1, len(data) - 1))
    numbers = numbering()
    words = numbered(raw, WORD, WORD, numbers)
    n = len(words)
    if not n:
        return out
    times = np.bincount(words)
    length = np.fromiter(map(len, numbers), np.int64, len(numbers))
    whole = words.astype(np.uint64)
    triples = whole[:-2] * np.uint64(0x9E3779B97F4A7C15) + whole[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + whole[2:]
    out[SIDE * SIDE :] = [
        np.log1p(n),
        np.log1p(len(raw)),
        np.log1p((length * times).sum() / n),
        len(numbers) / n,
        times.max() / n,
        (words[1:] == words[:-1]).mean() if n > 1 else 0.0,
        1 - len(np.unique(triples)) / len(triples) if n > 2 else 0.0,
        times[length <= 3].sum() / n,
        times[length >= 12].sum() / n,
        np.log1p(raw.count(b"\n")) / np.log1p(n),
    ]
    return out


def spread(z: np.ndarray) -> np.ndarray:
    """The logistic curve, without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray, rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
        scale = x.std(0)
        return cls(x.mean(0), np.where(scale > 1e-6, scale, 1.0), rng.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.normal(size=hidden) / np.sqrt(hidden), np.zeros(1))

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Features in units of their spread, none further out than 8 of them."""
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.inner + self.inner_bias) @ self.outer + self.outer_bias[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return spread(self.value(x))

    def train(self, positive: np.ndarray, other: np.ndarray, slopes, rng: np.random.Generator, steps: int = STEPS) -> Network:
        """Adam over batches of both sides; ``slopes(values of positives, values of others)`` are the derivatives of the risk."""
        positive, other = self.standard(positive), self.standard(other)
        parts = [self.inner, self.inner_bias, self.outer, self.outer_bias]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, steps + 1):
            some = [positive[rng.integers(0, len(positive), BATCH)], other[rng.integers(0, len(other), 2 * BATCH)]]
            x = np.concatenate(some)
            h = np.tanh(x @ self.inner + self.inner_bias)
            z = h @ self.outer + self.outer_bias[0]
            d = np.concatenate(slopes(z[:BATCH], z[BATCH:]))
            back = d[:, None] * self.outer * (1 - h * h)
            slope = [x.T @ back + DECAY * self.inner, back.sum(0), h.T @ d + DECAY * self.outer, d.sum(keepdims=True)]
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(parts, slope, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def apart(positive: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the plain logistic risk of telling positives from unlabelled rows."""
    return -spread(-positive) / (2 * len(positive)), spread(other) / (2 * len(other))


def non_negative(prior: float):
    """Derivatives of the non-negative unbiased risk under ``prior``."""

    def slopes(positive: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = np.logaddexp(0, other).mean() - prior * np.logaddexp(0, positive).mean()
        down_positive, down_other = -prior * spread(positive) / len(positive), spread(other) / len(other)
        if rest < 0:
            return -down_positive, -down_other
        return down_positive - prior * spread(-positive) / len(positive), down_other

    return slopes


def best_bin(positive: np.ndarray, other: np.ndarray, sure: float = 0.1, slack: float = 0.01) -> float:
    """The prior from scores of held-back rows: the least share of unlabelled over positive rows above a cut.

    Above a cut that only good rows reach, the unlabelled share is the prior times the positive one. The cut is chosen by the
    share plus what chance may add to it, so that a cut few rows reach is not trusted.
    """
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(other), cuts) / len(other)
    chance = np.sqrt(np.log(4 / sure) / 2) * (len(positive) ** -0.5 + len(other) ** -0.5)
    at = np.argmin((u + (1 + slack) * chance) / p)
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


@dataclass
class Model:
    """The fitted network and the prior it was fitted under; without trusted positives there is no network."""

    prior: float
    network: Network | None

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.network is None else self.network.score(x)


def learn(positive: np.ndarray, other: np.ndarray, seed: int = 7, steps: int = STEPS) -> Model:
    """Estimate the prior on one half of either side with a classifier of the other half, then minimise the risk over all."""
    rng = np.random.default_rng(seed)
    if not len(positive) or not len(other):
        return Model(0.5, None)
    if min(len(positive), len(other)) < 4:
        prior = 0.5
    else:
        rank = Network.start(other, rng).train(positive[::2], other[::2], apart, rng, steps // 2)
        prior = best_bin(rank.value(positive[1::2]), rank.value(other[1::2]))
    return Model(prior, Network.start(other, rng).train(positive, other, non_negative(prior), rng, steps))


def _described(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` and the features of the text as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(raw.as_buffer().to_pybytes()).tobytes() for raw in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(x, pa.binary())], names=[*keep, "x"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", x binary"
    return rows.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, fold: int = 5) -> Model:
    """Learn from ``labels`` of rows whose CRC-32 of the id is not divisible by ``fold``.

    Trusted are ids labelled 1 and never 0; nothing else of the labels is read. At most ``positives`` of them and
    ``unlabelled`` ids of documents are taken, the least by a hash of the id. Rows that repeat an id all count; null ids take
    no part.
    """
    learnt = crc_of_id(F.col("id")) % fold != 0
    named = labels.select(F.col(key).alias("id"), F.col("quality").alias("q")).where(F.col("id").isNotNull() & F.col("q").isNotNull())
    trusted = named.where(learnt).groupBy("id").agg(F.min("q").alias("q")).where("q = 1").join(docs.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    some = lambda ids, n: ids.select("id").orderBy(F.xxhash64("id"), "id").limit(n)
    ids = docs.select(F.col(key).alias("id")).where(F.col("id").isNotNull() & learnt).distinct()
    marks = some(trusted, positives).withColumn("side", F.lit(1)).unionByName(some(ids, unlabelled).withColumn("side", F.lit(0)))
    # Both sides are bounded by the parameters, so they may be sent to the texts; an id may be on both.
    sides = marks.groupBy("id").agg(F.sum("side").alias("positive"), F.sum(1 - F.col("side")).alias("other"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sides), "id")
    frame = _described(texts, ["id", "positive", "other"], "text").toPandas().sort_values(["id", "x"])
    if not len(frame):
        return Model(0.5, None)
    x = np.stack([np.frombuffer(b, np.float64) for b in frame["x"]])
    # Ids in the order of their hash, so that halves do not follow the ids.
    order = np.random.default_rng(1).permutation(len(x))
    positive, other = frame["positive"].to_numpy()[order] > 0, frame["other"].to_numpy()[order] > 0
    return learn(x[order][positive], x[order][other])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being good, 0 to 1, in ``into``, which replaces a column of that name.

    A null text is an empty one; without trusted positives every score is 0.5. Each row depends on its own text only.
    """
    own = [c for c in docs.columns if c.lower() != into.lower()]
    body = fresh(docs, "_body")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(raw.as_buffer().to_pybytes()) for raw in batch.column(len(own))]).reshape(-1, WIDTH)
            yield pa.record_batch([*batch.columns[: len(own)], pa.array(model.score(x), pa.float64())], names=[*own, into])

    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn(into, F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)
