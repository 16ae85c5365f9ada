"""Personal data by a semi-Markov conditional random field over candidate spans, beside fixed base rules.

Base rules find what is certain. The field adds what they miss: it scores whole candidate spans of a window of tokens (their
digits, groups, check sums, neighbours and cue words, all at once) and a dynamic program over windows, with spans of at most
``LONGEST`` tokens, picks boundaries and kinds jointly. Windows are the stretches around digits and at signs; outside them no
candidate exists, so the whole text is covered at the cost of its windows.

The weights are learned by maximum likelihood from windows of a bounded sample, labelled by the base rules, and from spelled-out
variants and look-alikes that are derived from them. A span of the field that overlaps a base span is dropped.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.columns import fresh
from tidemark.llm.held import begin

#: The kinds in order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _emails(text: str) -> Iterator[Span]:
    # From each at sign outwards: the leftmost match of a run of local characters is the whole run.
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        last = found.end() if found else at + 1
        if found:
            yield "email", start, last
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Matches of the base rules, leftmost and non-overlapping per kind; failing matches are dropped and not retried."""
    out = list(_emails(text))
    # Starting in the middle of a run of digits never helps, so the pattern may ask for its start.
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# ---- windows, tokens, candidates

#: Digits with up to three signs or a dot in brackets (also written out) between them, or an at sign (likewise) between words.
NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:(?:[\x20().\[\]/-]{0,3}|\s{0,3}[(\[]\s{0,3}(?:dot|\.)\s{0,3}[)\]]\s{0,3})[0-9])+", re.I)
AT = re.compile(r"@|[(\[]at[)\]]", re.I)
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.I)
AROUND = re.compile(r"[A-Za-z0-9._%+-]{1,64}[\x20(\[]{0,2}$"), re.compile(r"[\x20)\]]{0,2}[A-Za-z0-9-]{1,64}(?:[\x20(\[]{0,2}(?:\.|dot)[\x20)\]]{0,2}[A-Za-z0-9-]{1,64}){0,6}", re.I)
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\S")
LONGEST, CONTEXT = 24, 24
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile", "ring")}


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity, merged where they overlap."""
    found = [m.span() for m in NUMBERS.finditer(text) if m.end() - m.start() >= 7]
    at_signs = AT.finditer(text) if "@" in text or "at)" in text.lower() or "at]" in text.lower() else ()
    for m in at_signs:
        left, right = AROUND[0].search(text[max(0, m.start() - 66) : m.start()]), AROUND[1].match(text, m.end())
        if left and right:
            found.append((m.start() - len(left[0]), right.end()))
    if " dot " in text.lower():
        found += [m.span() for m in SPELLED.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def plain(kind: str, span: str) -> str:
    """A span with written-out signs put back."""
    if kind == "email":
        span = re.sub(r"\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+", "@", span, flags=re.I)
        return re.sub(r"\s*[(\[]\s*(?:dot|\.)\s*[)\]]\s*|\s+dot\s+", ".", span, flags=re.I)
    if kind == "ip":
        return re.sub(r"\s*[(\[]\s*(?:dot|\.)\s*[)\]]\s*", ".", span, flags=re.I)
    return span


NAMES = (
    "bias", "whole", "checked", "count_fits", "count_off", "plus", "brackets", "bare", "groups_even", "last_four", "many_groups", "mixed_signs", "odd_signs", "glued_left", "glued_right", "cue", "zeros", "spelled", "long_run", "starts_low",
)


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Features of the whole span ``text[start:end]`` as an entity of ``kind``, in the order of ``NAMES``."""
    span = text[start:end]
    straight = plain(kind, span)
    digits = only_digits(straight)
    groups = re.findall(r"[0-9]+", straight)
    signs = re.sub(r"[0-9]", "", straight)
    before, after = text[start - 1 : start], text[end : end + 1]
    if kind == "email":
        whole = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", straight))
        fits, checked = straight.count("@") == 1, "." in straight.rpartition("@")[2]
    elif kind == "ip":
        whole = bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", straight))
        fits, checked = len(groups) == 4, all(int(g[:4]) <= 255 for g in groups)
    elif kind == "card":
        whole = bool(re.fullmatch(r"[0-9]([ .-]{0,2}[0-9])+", straight))
        fits, checked = 12 <= len(digits) <= 19, luhn(digits) and bool(digits)
    else:
        whole = bool(re.fullmatch(r"\+?(00)?[0-9 ().-]+", straight)) and straight.count("(") == straight.count(")") <= 1
        fits, checked = 9 <= len(digits) <= 15, bool(re.search(r"[)-].*[-. ]|[-. ].*[-. ].*[-. ]", straight))
    sizes = [len(g) for g in groups]
    near = text[max(0, start - CONTEXT) : start].lower()
    return [
        1.0, whole, checked, fits, not fits, span.startswith(("+", "00", "(+")), "(" in straight and ")" in straight, not signs.strip(), len(set(sizes[:-1])) <= 1 and len(sizes) > 2,
        bool(sizes) and sizes[-1] == 4, len(groups) > 5, len(set(signs) - {" "}) > 1, bool(re.search(r"[^ ().@+_%A-Za-z-]", signs)), bool(before and (before.isalnum() or before in "+.-/@")),
        bool(after and (after.isalnum() or after in "@" or (after in ".-/" and text[end + 1 : end + 2].isalnum()))), any(c in near for c in CUES[kind]), digits.startswith("00") and not span.startswith("00"), span != straight,
        bool(sizes) and max(sizes) > 12, bool(sizes) and sizes[0] == 4 and straight[:2] in ("19", "20"),
    ]


@dataclass
class Lattice:
    """Candidates of one window: ends in token order, so that one sweep sees every predecessor first."""

    tokens: list[tuple[int, int]]
    spans: list[tuple[int, int, int]]  # kind, first token, token after the last
    x: np.ndarray


def lattice(text: str, a: int, b: int) -> Lattice:
    """Tokens and candidate spans of the window ``text[a:b]``.

    A candidate begins with a digit, ``+``, ``(`` or a word and ends with a digit or a word; numbers hold no letters, and an
    email holds an at sign. Spans that cannot be any kind are not built.
    """
    tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
    spans, rows = [], []
    for i, (s, _) in enumerate(tokens):
        head = text[s]
        if not (head.isalnum() or head in "+("):
            continue
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            e = tokens[j - 1][1]
            if not text[e - 1].isalnum():
                continue
            span = text[s:e]
            digits = sum(c.isdigit() for c in span)
            if re.search(r"@|\bat\b", span, re.I):
                kinds = ("email",) if head.isalnum() and re.search(r"\.|dot", span, re.I) else ()
            elif re.search(r"[A-Za-z]", re.sub(r"[(\[]\s*dot\s*[)\]]", "", span, flags=re.I)):
                kinds = ()
            else:
                kinds = tuple(k for k, fits in (("ip", plain("ip", span).count(".") >= 3 and digits <= 12 and head.isdigit()), ("card", 12 <= digits <= 19 and head.isdigit()), ("phone", 9 <= digits <= 15)) if fits)
            for kind in kinds:
                spans.append((KINDS.index(kind), i, j))
                rows.append(features(kind, text, s, e))
    order = sorted(range(len(spans)), key=lambda n: spans[n][2])
    return Lattice(tokens, [spans[n] for n in order], np.array([rows[n] for n in order], float).reshape(len(rows), len(NAMES)))


LABELS = len(KINDS)  # the label after the kinds is "outside"


@dataclass
class Field:
    """Weights: one row per kind over ``NAMES``, and one entry for each pair of neighbouring labels."""

    kinds: np.ndarray
    steps: np.ndarray

    @classmethod
    def zero(cls) -> Field:
        return cls(np.zeros((LABELS, len(NAMES))), np.zeros((LABELS + 1, LABELS + 1)))

    def scores(self, lat: Lattice) -> np.ndarray:
        return (lat.x * self.kinds[[k for k, _, _ in lat.spans]]).sum(1) if lat.spans else np.zeros(0)

    def best(self, text: str, a: int, b: int) -> list[Span]:
        """The likeliest segmentation of a window."""
        lat = lattice(text, a, b)
        if not lat.spans:
            return []
        score, n = self.scores(lat), len(lat.tokens)
        best = np.full((n + 1, LABELS + 1), -np.inf)
        best[0, LABELS] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        at = 0
        for j in range(1, n + 1):
            prior = best[j - 1] + self.steps[:, LABELS]
            p = int(prior.argmax())
            best[j, LABELS], back[j, LABELS] = prior[p], (j - 1, p)
            while at < len(lat.spans) and lat.spans[at][2] == j:
                kind, i, _ = lat.spans[at]
                prior = best[i] + self.steps[:, kind] + score[at]
                p = int(prior.argmax())
                if prior[p] > best[j, kind]:
                    best[j, kind], back[j, kind] = prior[p], (i, p)
                at += 1
        j, label, out = n, int(best[n].argmax()), []
        while j:
            i, before = back[j, label]
            if label < LABELS:
                out.append((KINDS[label], lat.tokens[i][0], lat.tokens[j - 1][1]))
            j, label = i, before
        return out[::-1]

    def gradient(self, lat: Lattice, gold: set[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold segmentation and its gradient, by forward and backward sums over segmentations."""
        score, n = self.scores(lat), len(lat.tokens)
        fore, hind = np.full((n + 1, LABELS + 1), -np.inf), np.full((n + 1, LABELS + 1), -np.inf)
        fore[0, LABELS], hind[n] = 0, 0
        logsum = lambda v: (m := v.max()) + np.log(np.exp(v - m).sum()) if v.max() > -np.inf else -np.inf
        at = 0
        for j in range(1, n + 1):
            fore[j, LABELS] = logsum(fore[j - 1] + self.steps[:, LABELS])
            while at < len(lat.spans) and lat.spans[at][2] == j:
                kind, i, _ = lat.spans[at]
                fore[j, kind] = np.logaddexp(fore[j, kind], logsum(fore[i] + self.steps[:, kind]) + score[at])
                at += 1
        arcs = [(LABELS, i, i + 1, 0.0, None) for i in range(n)] + [(k, i, j, score[m], m) for m, (k, i, j) in enumerate(lat.spans)]
        for label, i, j, s, _ in sorted(arcs, key=lambda arc: -arc[1]):
            hind[i] = np.logaddexp(hind[i], self.steps[:, label] + s + hind[j, label])
        total = logsum(fore[n])
        kinds, steps, value = np.zeros_like(self.kinds), np.zeros_like(self.steps), -total
        for label, i, j, s, m in arcs:
            share = np.exp(fore[i] + self.steps[:, label] + s + hind[j, label] - total)
            steps[:, label] -= share
            if m is not None:
                kinds[label] -= share.sum() * lat.x[m]
        place, before, index = 0, LABELS, {span: m for m, span in enumerate(lat.spans)}
        starts = {i: (k, i, j) for k, i, j in gold}
        while place < n:
            label, _, j = starts.get(place, (LABELS, place, place + 1))
            value += self.steps[before, label]
            steps[before, label] += 1
            if label < LABELS:
                m = index[label, place, j]
                value += score[m]
                kinds[label] += lat.x[m]
            place, before = j, label
        return value, kinds, steps

    def spans(self, text: str) -> list[tuple[str, int, int, bool]]:
        """All spans of a text, true for those of the base rules."""
        base = base_spans(text)
        found = [(*s, True) for s in base]
        by_start = sorted((start, end) for _, start, end in base)
        starts, ends = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))

        def reach(place: int) -> int:
            """The furthest end of the base spans that start before a place."""
            at = bisect_left(starts, place)
            return ends[at - 1] if at else 0

        for a, b in windows(text):
            if reach(a + 1) < b:
                found += [(*s, False) for s in self.best(text, a, b) if reach(s[2]) <= s[1]]
        return sorted(found, key=lambda s: (_order(s[:3]), s[2]))


# ---- training

def _variant(rng: random.Random, kind: str, span: str) -> str:
    """The same entity as it is written to be read by people only."""
    if kind == "email":
        at, dot = rng.choice([(" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")])
        name, _, domain = span.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", "(.)", "[dot]"]))
    if kind == "card":
        digits = only_digits(span)
        return rng.choice([".", "  ", "-", " "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = only_digits(span)
    area, mid, end = digits[-10:-7], digits[-7:-4], digits[-4:]
    lead = digits[:-10]
    return rng.choice([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"{lead or 1} ({area}) {mid}-{end}", f"00{lead or 1} {area} {mid} {end}", f"{lead or 1}-{area}-{mid}-{end}"])


def _made(rng: random.Random, kind: str) -> str:
    """An entity of one's own, for corpora whose sample has few."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    if kind == "email":
        return f"{w()}{rng.choice(['', '.', '_'])}{w()}{rng.choice(['', d(2)])}@{w()}.{rng.choice(['com', 'org', 'co.uk', 'net'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        head = rng.choice("3456") + d(14)
        return head + next(c for c in "0123456789" if luhn(head + c))
    return f"+{rng.randint(1, 99)} ({rng.randint(200, 999)}) {d(3)}-{d(4)}"


def _lookalike(rng: random.Random) -> str:
    """Numbers and signs that are nobody's data."""
    n = lambda a, b: rng.randint(a, b)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    bad = d(16)
    while luhn(bad):
        bad = d(16)
    return rng.choice([
        f"{n(1900, 2030)}-{n(10, 12)}-{n(10, 31)}", f"{n(1900, 2030)}-{n(1900, 2030)}", f"{n(1, 999)}.{d(7)}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 99)}", bad, " ".join((bad[:4], bad[4:8], bad[8:12], bad[12:])), d(9), d(10), d(12),
        f"{n(256, 999)}.{n(256, 999)}.{n(1, 99)}.{n(1, 99)}", " ".join(str(n(1, 99999)) for _ in range(n(3, 8))), f"{n(10, 23)}:{n(10, 59)} {n(1, 30)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(1900, 2030)} {n(1900, 2030)} {n(1900, 2030)}",
        f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)} {d(3)} {d(3)}", f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}.{n(1, 9)}", f"@{d(5)}", "meet at noon dot", f"{d(20)}",
    ])


def learn(examples: list[tuple[str, list[Span]]], seed: int = 7, per_kind: int = 60, rounds: int = 25, rate: float = 0.15, decay: float = 0.02) -> Field:
    """Fit a field on texts with their base spans, their variants and look-alikes; the same input gives the same field."""
    rng = random.Random(seed)
    by_kind: dict[str, list[str]] = {k: [] for k in KINDS}
    contexts = [("", ""), ("the ", " of it"), ("to ", ". And"), ("(", ")"), ("call ", ","), ("mail ", " now"), ("ip ", " is")]
    for text, spans in examples:
        for kind, s, e in spans:
            by_kind[kind].append(text[s:e])
            contexts.append((re.sub(r"[0-9@]", "", text[max(0, s - CONTEXT) : s]), re.sub(r"[0-9@]", "", text[e : e + CONTEXT])))
    cases: list[tuple[str, Span | None]] = []
    for kind in KINDS:
        for n in range(per_kind):
            span = rng.choice(by_kind[kind]) if by_kind[kind] and n % 2 else _made(rng, kind)
            left, right = rng.choice(contexts)
            written = span if n % 3 == 0 else _variant(rng, kind, span)
            cases.append((left + written + right, (kind, len(left), len(left) + len(written))))
    for _ in range(4 * per_kind):
        left, right = rng.choice(contexts)
        cases.append((left + _lookalike(rng) + right, None))
    data = []
    for text, entity in cases:
        for a, b in windows(text):
            lat = lattice(text, a, b)
            gold = {(k, i, j) for k, i, j in lat.spans if entity and (KINDS[k], lat.tokens[i][0], lat.tokens[j - 1][1]) == entity}
            if lat.spans and (gold or entity is None):
                data.append((lat, gold))
    field = Field.zero()
    seen = [np.full_like(field.kinds, 1e-8), np.full_like(field.steps, 1e-8)]
    for _ in range(rounds):
        rng.shuffle(data)
        for lat, gold in data:
            _, kinds, steps = field.gradient(lat, gold)
            for value, slope, past in ((field.kinds, kinds, seen[0]), (field.steps, steps, seen[1])):
                slope = slope - decay * value / max(1, len(data) / 50)
                past += slope**2
                value += rate * slope / np.sqrt(past)
    return field


HIT = re.compile(r"@|[+(]?[0-9][0-9 ().-]{6,64}[0-9]")


def pieces(text: str, most: int = 8) -> str:
    """What stands around the first hits of a text, which is enough to learn from; finding spans reads whole texts.

    An at sign takes up to 88 characters on either side, a number 24; a piece begins where the one before it ends.
    """
    out: list[str] = []
    done = 0
    for m in HIT.finditer(text):
        if m.end() <= done:
            continue
        reach = 88 if m[0] == "@" else 24
        start, done = max(done, m.start() - reach), m.end() + reach
        out.append(text[start:done])
        if len(out) == most:
            break
    return " \n ".join(out)


def fit(docs: DataFrame, text: str = "text", rows: int = 400) -> Field:
    """Learn from at most ``rows`` documents with an at sign or seven digits, those with the least hash; only windows travel.

    The rows are chosen by their whole texts, and pieces are then cut from those alone (:func:`pieces`).
    """
    hits = docs.where(F.col(text).rlike(r"@[A-Za-z0-9-]|\+[0-9]|[0-9]{4}[ -]?[0-9]{3}|[0-9]\.[0-9]{1,20}\.[0-9]{1,20}\.[0-9]")).select(F.col(text).alias("t"))
    chosen = hits.select(F.xxhash64("t").alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    few = hits.where(F.xxhash64("t") <= F.lit(chosen)).select(F.xxhash64("t").alias("h"), "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([pieces(t) for t in batch.column(1).to_pylist()], pa.string())], names=["h", "t"])

    sample = few.mapInArrow(cut, "h long, t string").orderBy("h", "t").limit(rows).select("t").collect()
    return learn([(r.t, base_spans(r.t)) for r in sample])


# ---- tables

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def annotate(docs: DataFrame, field: Field, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of spans: kind, start, end (code points, end exclusive), and whether the base rules found it.

    A null text is empty; rows are independent, so repeated rows get equal spans; other columns are passed on as they are.
    """
    name, = fresh(docs, into)
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in field.spans(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, SPANS)]))


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets; overlapping spans become one. Null stays null."""
    at = docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if value is None:
            return None
        out, done = [], 0
        for kind, start, end, _ in field.spans(value):
            if start >= done:
                out += [value[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in batch.column(at).to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
