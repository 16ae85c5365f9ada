"""What a worker keeps: one operator's memory at a time, and small arrays for blocks of texts."""

import gc
import tracemalloc
import weakref

import numpy as np
import pandas as pd
import public_tokenizers

from tidemark.llm import bpe, held, jaccard, tokenfiles, toxicity


def test_what_one_operator_kept_goes_when_another_starts():
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ours = bpe.loaded(path, pattern)
    assert bpe.loaded(path, pattern) is ours
    gone = weakref.ref(ours)
    del ours
    other = tokenfiles.encoder(public_tokenizers.path("byte_bpe_50k.json"), pattern)
    gc.collect()
    assert gone() is None and tokenfiles.encoder(public_tokenizers.path("byte_bpe_50k.json"), pattern) is other
    gone = weakref.ref(other)
    del other
    held.begin("toxicity")
    gc.collect()
    assert gone() is None


def test_two_keys_are_kept():
    made = []
    make = lambda name: held.kept("a", (name,), lambda: made.append(name) or name)
    assert [make(n) for n in "xyxyzzyx"] == list("xyxyzzyx") and made == list("xyzx")


def test_arrays_of_a_block_stay_small():
    """Both take a batch of many texts block by block; an executor has two workers beside its heap."""
    texts = ["some words of a text, " * 150] * 1000
    index = toxicity.Lookup(toxicity.grams(["a"])[0], np.zeros(2))
    for read in (lambda: [len(g) for g in jaccard.shingle_sets(texts)], lambda: toxicity.means(texts, index)):
        toxicity.powers.cache_clear()
        jaccard.powers.cache_clear()
        tracemalloc.start()
        read()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32e6


def test_gram_counts_of_a_large_batch_gather_little(monkeypatch):
    """A batch of many texts is merged block by block, and what is handed on still adds up to every gram."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice(list(b"abcdefghijkl  "), 2500).tolist()).decode() for _ in range(400)]
    batch = pd.DataFrame({"text": texts, "part": np.arange(400) % 4})
    whole = pd.concat(toxicity.counted(iter([batch]))).groupby("gram").sum()
    assert whole[["c0", "c1", "c2", "c3"]].to_numpy().sum() == len(toxicity.grams(texts)[0])
    monkeypatch.setattr(toxicity, "GATHERED", 1 << 14)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1 << 16)
    tracemalloc.start()
    most = max(len(frame) for frame in toxicity.counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 1 << 14 and peak < 20e6
    parts = pd.concat(toxicity.counted(iter([batch])))
    assert len(parts) > len(whole) and parts.drop(columns="root").groupby("gram").sum().equals(whole.drop(columns="root"))
