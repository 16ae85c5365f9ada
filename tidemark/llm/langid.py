"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is lower-cased and cut into windows of ``WINDOW`` bytes that overlap by the widest filter less one, so every n-gram
lies whole in a window; the last one is padded. Filters of several widths run over the bytes, the largest response of each
filter is kept, and a softmax layer turns the responses into probabilities. A text's probabilities are the mean over its
windows, weighted by their bytes. As input bytes are one-hot, a filter is a sum of table rows: one table per offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.columns import blocks, crc_of_id, flat_bytes

#: Filter widths, each with as many filters.
WIDTHS = {2: 8, 3: 12, 4: 12}
WIDEST, FILTERS = max(WIDTHS), sum(WIDTHS.values())
WINDOW = 256
#: Bytes that are cut into windows at a time, and windows that are computed at a time.
BLOCK_BYTES, AT_ONCE = 1 << 20, 64
UNKNOWN = "und"


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matrix of windows, the text that each comes from, and its number of bytes. An empty text has no window."""
    flat, ends = flat_bytes([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    sizes, stride = np.diff(ends), WINDOW - WIDEST + 1
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // stride)), 0)
    of = np.repeat(np.arange(len(texts)), counts)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = ends[of] + rank * stride
    place = start[:, None] + np.arange(WINDOW)
    inside = place < ends[of + 1][:, None]
    raw = np.where(inside, flat[np.minimum(place, max(0, len(flat) - 1))], 0) if len(of) else np.zeros((0, WINDOW))
    return raw.astype(np.uint8), of, inside.sum(1)


@dataclass
class Network:
    """``tables[k]`` holds the filters' weights for the byte at offset ``k``; a narrower filter has zeros at later offsets."""

    languages: list[str]
    tables: np.ndarray  # offsets, bytes, filters
    bias: np.ndarray
    dense: np.ndarray  # filters, languages
    level: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.3, (WIDEST, 256, FILTERS)).astype(np.float32)
        tables *= cls.mask()
        return cls(languages, tables, np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, (FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        width = np.concatenate([np.full(n, w) for w, n in WIDTHS.items()])
        return (np.arange(WIDEST)[:, None, None] < width).astype(np.float32)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Filter responses at every position of every window."""
        n = WINDOW - WIDEST + 1
        out = np.take(self.tables[0], raw[:, :n], axis=0)
        for k in range(1, WIDEST):
            out += np.take(self.tables[k], raw[:, k : k + n], axis=0)
        return out

    def head(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(top + self.bias, 0)
        score = hidden @ self.dense + self.level
        score = np.exp(score - score.max(1, keepdims=True))
        return hidden, score / score.sum(1, keepdims=True)

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        parts = [self.head(self.responses(raw[i : i + AT_ONCE]).max(1))[1] for i in range(0, len(raw), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and mean probability of each text; ``und`` and 0 without a letter or without a trained language."""
        names, scores = [], []
        for block in blocks([len(t) for t in texts], BLOCK_BYTES):
            part = texts[block]
            known = np.array([any(map(str.isalpha, t)) for t in part], bool) & bool(self.languages)
            raw, of, size = windows([t if k else "" for t, k in zip(part, known, strict=True)])
            total = np.zeros((len(part), max(1, len(self.languages))))
            if len(raw):
                np.add.at(total, of, self.probabilities(raw) * size[:, None])
                total /= np.maximum(np.bincount(of, size, len(part)), 1)[:, None]
            best = total.argmax(1)
            names += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, total.max(1), 0.0))
        return names, np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)


def train(raw: np.ndarray, label: np.ndarray, languages: list[str], rounds: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
    """Cross-entropy by Adam. Only the position of a filter's largest response carries a gradient, so a step is cheap."""
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    if not len(raw):
        return net
    weights = [net.tables, net.bias, net.dense, net.level]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    mask, step = net.mask(), 0
    # Each language counts alike, however many windows it has.
    per = np.bincount(label, minlength=len(languages))
    gain = (len(label) / np.maximum(per, 1) / max(1, (per > 0).sum()))[label]
    for _ in range(rounds):
        order = rng.permutation(len(raw))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            x, y, n = raw[rows], label[rows], len(rows)
            seen = net.responses(x)
            at = seen.argmax(1)
            top = np.take_along_axis(seen, at[:, None], 1)[:, 0]
            hidden, p = net.head(top)
            slope = p.copy()
            slope[np.arange(n), y] -= 1
            slope *= (gain[rows] / n)[:, None]
            back = (slope @ net.dense.T) * (hidden > 0)
            tables = np.zeros_like(net.tables)
            for k in range(WIDEST):
                np.add.at(tables[k], (np.take_along_axis(x, at + k, 1), np.arange(FILTERS)), back)
            grads, step = [tables * mask, back.sum(0), hidden.T @ slope, slope.sum(0)], step + 1
            for w, g, a, b in zip(weights, grads, first, second, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held: int = 1, rows: int = 500, per_text: int = 4, most: int = 256) -> Network:
    """Train on labelled rows whose CRC-32 of the id leaves another remainder than ``held`` modulo ``folds``.

    The sample is bounded: of each of the ``most`` commonest languages about ``rows`` texts, chosen by hash, and of each text
    at most ``per_text`` windows, spread evenly over the whole text. Rows without text or letters are not used.
    """
    crc = crc_of_id(F.col(key))
    usable = docs.where((crc % folds != held) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(key).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    languages = sorted(counts)
    if not languages:
        return Network.fresh([])
    share = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    keep = F.lit(False)
    for name, n in counts.items():
        keep = keep | ((F.col("lang") == name) & (share < min(1.0, rows / n)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, value in zip(batch["lang"], batch["text"], strict=True):
                raw = windows([value])[0]
                chosen = raw[np.unique(np.linspace(0, len(raw) - 1, min(len(raw), per_text)).astype(int))]
                yield pd.DataFrame({"lang": [name] * len(chosen), "raw": [r.tobytes() for r in chosen]})

    sample = usable.where(keep).select("lang", "text").mapInPandas(cut, "lang string, raw binary").orderBy("lang", "raw").toPandas()
    raw = np.frombuffer(b"".join(sample["raw"]), np.uint8).reshape(-1, WINDOW)
    index = {name: i for i, name in enumerate(languages)}
    return train(raw, sample["lang"].map(index).to_numpy(int), languages)


def predict(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for every row of ``docs``; see :meth:`Network.predict`. A null text has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = shared.value.predict(batch["t"].tolist())
            yield pd.DataFrame({"k": batch["k"], "lang_pred": names, "score": scores})

    plain = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return plain.mapInPandas(run, "k string, lang_pred string, score double").select(F.col("k").cast(docs.schema[key].dataType).alias(key), "lang_pred", "score")
