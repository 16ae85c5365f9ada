"""The pipeline's stages: columns, effects, odd rows, and equality with plain versions of what is deterministic."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.test_jaccard import brute, corpus
from tidemark.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered_and_shaped(spark, sf):
    assert entry.queries()["pipeline"] is cp.run and [len(s) for s in cp.STAGES] == [2] * 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert rows or name == "none"
        docs = spark.createDataFrame(rows, out.schema)
    assert {len(r.ids_sha256) for r in rows} == {64}


def test_one_row_of_each_component_stays(spark):
    rows = corpus(4, 250)
    table = [(k, t, "en", "s", len(t)) for k, t in rows]
    table += [(0, rows[0][1], "en", "s", 1), (0, rows[0][1], "en", "s", 1), (None, rows[5][1], None, None, None), (900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "only here and nowhere else ok", None, None, None)]
    out = jaccard.deduplicated(spark.createDataFrame(table, SCHEMA).repartition(4)).collect()
    want = {(k, t) for k, t in rows if k in {c for _, _, c in brute(rows)}} | {(900, None), (901, ""), (None, "only here and nowhere else ok")}
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(want, key=str)


def test_mix_repeats_and_drops_whole_rows(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "big" if i % 3 else f"s{i % 9}", 1) for i in range(300)]
    out = cp.sources_mixed(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    counts = {}
    for r in out:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
        assert tuple(r) == rows[r.doc_id]
    assert max(counts.values()) <= 3 and len(counts) < 300


def test_personal_data_goes_and_lengths_follow(spark):
    df = spark.createDataFrame([(1, "write a@b.co or 1.2.3.4", "en", "s", 23), (2, None, "en", "s", 7), (3, "clean", "en", "s", 5)], SCHEMA)
    out = {r.doc_id: (r.text, r.n_chars) for r in cp.personal_data_out(spark, df, "").collect()}
    assert out == {1: ("write [EMAIL] or [IP]", 21), 2: (None, 7), 3: ("clean", 5)}


@pytest.mark.parametrize("k", range(1, 5))
def test_stages_take_empty_tables(spark, sf, k):
    assert cp.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), sf).count() == 0


def test_tokens_decode_to_the_text(spark, sf):
    df = spark.createDataFrame([(1, "é  x's", "en", "s", 1), (2, None, None, None, None)], SCHEMA)
    out = {r.doc_id: r.decoded_sha256 for r in cp.tokens(spark, df, sf).collect()}
    assert out == {1: hashlib.sha256("é  x's".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
