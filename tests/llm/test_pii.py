"""Base rules against the patterns as written, the field against enumeration, tables against plain calls."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import pii

FIELD = pii.learn([])
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def literal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 12 <= len(digits(s)) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits(s)[::-1])) % 10 == 0,
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    out = [(k, *m.span()) for k, p in zip(pii.KINDS, (EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text) if keep[k](m[0])]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.B@-_%+0123456789() \n", max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == literal(text)


@pytest.mark.parametrize("text", [
    "a@b.co.uk, x@y z@@w.de q@r.s@t.u", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4429526289707589 4429 5262 8970 7589 4429-5262-8970-7588", "+1 (988) 555-2485+44 20 7946 0958 +1(2", "é@x.de ü1.2.3.4é",
    "1" * 5000, "0" * 4000 + ".1.1.1", "+1" + "(" * 5000, "a" * 5000 + "@", "@" * 3000, "a.b@" * 2000,
])
def test_base_on_odd_texts(text):
    assert pii.base_spans(text) == literal(text)


def segmentations(lat, i=0):
    if i == len(lat.tokens):
        yield []
        return
    for rest in segmentations(lat, i + 1):
        yield [(pii.LABELS, i, i + 1), *rest]
    for k, s, j in lat.spans:
        if s == i:
            for rest in segmentations(lat, j):
                yield [(k, s, j), *rest]


def value(field, lat, path):
    total, before, score = 0.0, pii.LABELS, {s: v for s, v in zip(lat.spans, field.scores(lat), strict=True)}
    for label, i, j in path:
        total += field.steps[before, label] + (score[label, i, j] if label < pii.LABELS else 0)
        before = label
    return total


@pytest.mark.parametrize("text", ["(415) 555-2671", "415 555 2671 99", "a at b dot com", "10[.]0[.]0[.]1", "4111.1111.1111.1111"])
def test_program_finds_the_best_and_sums_all(text):
    rng = np.random.default_rng(len(text))
    field = pii.Field(rng.normal(size=FIELD.kinds.shape), rng.normal(size=FIELD.steps.shape))
    (a, b), = pii.windows(text)
    lat = pii.lattice(text, a, b)
    paths = list(segmentations(lat))
    values = [value(field, lat, p) for p in paths]
    top = paths[int(np.argmax(values))]
    assert field.best(text, a, b) == [(pii.KINDS[k], lat.tokens[i][0], lat.tokens[j - 1][1]) for k, i, j in top if k < pii.LABELS]
    gold = {s for s in max(paths, key=len, default=[]) if s[0] < pii.LABELS} or {s for s in paths[-1] if s[0] < pii.LABELS}
    log, kinds, steps = field.gradient(lat, gold)
    path = next(p for p in paths if {s for s in p if s[0] < pii.LABELS} == gold)
    assert log == pytest.approx(value(field, lat, path) - np.logaddexp.reduce(values))
    for k, n in itertools.islice(zip(*np.nonzero(np.abs(kinds) > 1e-3)), 5):
        up = pii.Field(field.kinds.copy(), field.steps)
        up.kinds[k, n] += 1e-5
        assert (up.gradient(lat, gold)[0] - log) / 1e-5 == pytest.approx(kinds[k, n], rel=1e-2, abs=1e-3)


def test_field_adds_variants_and_leaves_numbers_alone():
    for text, kind in [("call (415) 555-2671 now", "phone"), ("write john.doe at mail dot com", "email"), ("john (at) mail.org", "email"), ("card 4111.1111.1111.1111 x", "card"), ("ip 10[.]0[.]0[.]1", "ip")]:
        assert [s[0] for s in FIELD.spans(text)] == [kind], text
    for text in ["2024-01-31 and 12345678901", "from 1999 2000 2001 2002", "order 1234567890", "4429526289707580", "meet at noon", "pi is 3.14159265358", "a b c", ""]:
        assert FIELD.spans(text) == [], text


def test_tables(spark):
    long = "word " * 30000 + "mail a@b.co"
    rows = [(1, "x a@b.co y 1.2.3.4", "s"), (1, "x a@b.co y 1.2.3.4", "s"), (None, None, None), (3, "", "s"), (4, long, "s"), (5, "+1 (988) 555-2485 é \U0001f600 4429526289707589", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    got = {(r.doc_id, tuple((s.kind, s.start, s.end, s.base) for s in r.spans_)) for r in pii.annotate(df, FIELD).collect()}
    assert got == {(k, tuple(FIELD.spans(t or ""))) for k, t, _ in rows}
    clean = {r.doc_id: r.text for r in pii.redact(df, FIELD).collect()}
    assert clean == {1: "x [EMAIL] y [IP]", None: None, 3: "", 4: "word " * 30000 + "mail [EMAIL]", 5: "[PHONE] é \U0001f600 [CARD]"}
    assert pii.annotate(df.limit(0), pii.fit(df.limit(0))).count() == 0
    assert pii.fit(df).kinds.shape == FIELD.kinds.shape


def test_every_variant_is_a_candidate_of_a_window():
    rng = random.Random(3)
    for kind in pii.KINDS:
        for n in range(300):
            written = pii._variant(rng, kind, pii._made(rng, kind))
            for left, right in (("", ""), ("the ", " of it"), ("call ", ","), ("(", ")")):
                for cased in (written, written.upper()):
                    text, s, e = left + cased + right, len(left), len(left) + len(cased)
                    around = [(a, b) for a, b in pii.windows(text) if a <= s and e <= b]
                    assert around, text
                    lat = pii.lattice(text, *around[0])
                    assert (kind, s, e) in {(pii.KINDS[k], lat.tokens[i][0], lat.tokens[j - 1][1]) for k, i, j in lat.spans}, text


@pytest.mark.parametrize("text, want", [
    ("the host 192[dot]168[dot]10[dot]20 is down", ("ip", "192[dot]168[dot]10[dot]20")), ("ip 10(DOT)20(DOT)30(DOT)41 is", ("ip", "10(DOT)20(DOT)30(DOT)41")),
    ("write to ANNA.B AT HOST DOT COM now", ("email", "ANNA.B AT HOST DOT COM")),
])
def test_written_out_signs_are_found(text, want):
    assert want in [(k, text[s:e]) for k, s, e, _ in FIELD.spans(text)]


def test_long_texts_end_within_seconds(spark):
    """2 MB without a space, a long run of digits, and 50,000 entities: nothing is quadratic in fitting or finding."""
    many = " ".join(f"a{i}@b.com" if i % 2 else f"10.0.{i % 256}.{i % 200}" for i in range(50_000))
    texts = ["x@y " + "q" * 2_000_000, "7" * 200_000 + ".1", many, "call +1 202 555 0100 or a@b.org"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    start = time.time()
    field = pii.fit(df)
    found = {r.doc_id: r.spans for r in pii.annotate(df, field).collect()}
    assert time.time() - start < 60
    assert sum(s.base for s in found[2]) == 50_000 and [s.kind for s in found[3] if s.base] == ["phone", "email"]


def test_pieces_stand_around_the_first_hits():
    text = "x" * 500 + " mail a@b.org " + "y" * 500 + " call 202-555-0100 now " + "z" * 300
    first, second = pii.pieces(text).split(" \n ")
    assert "a@b.org" in first and len(first) == 177 and second.startswith("y") and "202-555-0100 now" in second
    assert pii.pieces("") == "" and len(pii.pieces("q" * 3_000_000 + "@")) == 89


def test_spans_of_the_field_touch_no_base_span():
    text = "a@b.com 1.2.3.4 name (at) host (dot) org +1 202 555 0100 4111 1111 1111 1111 " * 5
    base = pii.base_spans(text)
    for kind, start, end, own in FIELD.spans(text):
        assert own == ((kind, start, end) in base)
        assert own or all(end <= s or e <= start for _, s, e in base)
