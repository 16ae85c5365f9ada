"""BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
OURS = bpe.loaded(PATH, PATTERN)
LIB = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
TEXTS = [
    "", "a", "Hello world's  end \n\n x", "\x1c\x1d \x85\xa0　x\x0b", "é漢字\U0001f600 ñandú 12,345 ½²", "aaaa" * 200, "ab" * 3000, "word " * 5000,
    "supercalifragilisticexpialidocious" * 7, "\t\t\n  ", "<|endoftext|>", "'s 'll 'LL", "x" * 127 + "y", "z" * 129,
]


@pytest.mark.parametrize("text", TEXTS)
def test_equal_to_library(text):
    ids = next(iter(OURS.encode([text])))
    assert ids.tolist() == LIB.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    for text, ids in zip(texts, OURS.encode(texts), strict=True):
        assert ids.tolist() == LIB.encode_ordinary(text)
        assert OURS.decode(ids) == text.encode() and OURS.decimals(ids) == ",".join(map(str, ids)).encode()


def test_heap_and_rounds_agree():
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"thenio a\xc3\xa9") for _ in range(rng.randint(2, 128))) for _ in range(300)]
    for a, p in zip(OURS._rounds(pieces), pieces, strict=True):
        assert a.tolist() == OURS._heap(p).tolist() == (LIB._core_bpe.encode_single_piece(p) if p not in OURS.ranks else a.tolist())


def test_frames(spark):
    rows = [(None if i == 3 else i % 5, None if i == 2 else t, i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(str, bpe.digests(df, PATH, PATTERN).collect()))
    want = []
    for key, text, _ in rows:
        ids = LIB.encode_ordinary(text or "")
        want.append(f"Row(doc_id={key}, n_tokens={len(ids)}, ids_sha256='{hashlib.sha256(','.join(map(str, ids)).encode()).hexdigest()}', decoded_sha256='{hashlib.sha256((text or '').encode()).hexdigest()}')")
    assert got == sorted(want)
    both = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN)
    assert sorted((r.n_tokens, bytes(r.decoded)) for r in both.collect()) == sorted((i, (t or "").encode()) for _, t, i in rows)
    assert bpe.digests(df.limit(0), PATH, PATTERN).count() == 0


def test_lookup_table():
    keys = np.random.default_rng(0).permutation(1 << 16)[:5000].astype(np.int64) * 12345
    from tidemark.llm.hashindex import HashIndex

    index = HashIndex(keys, np.arange(5000, dtype=np.int32))
    assert index.get(keys, -1).tolist() == list(range(5000)) and (index.get(keys + 1, -1) == -1).all()
    assert HashIndex(np.zeros(0, np.int64), np.zeros(0, np.int32)).get(np.array([0, 7]), -5).tolist() == [-5, -5]
