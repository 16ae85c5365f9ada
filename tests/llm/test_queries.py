"""Every registered query of the subpackage on the small tables, beside its SQL or a plain recomputation."""

import glob
import hashlib
import os
import zlib

import duckdb
import pytest

from tests.llm.test_pii import literal
from tests.llm.test_quality import brute
from tidemark.llm import pii, queries
from tools.check import cells


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, con, name):
    mine, theirs = queries.BUILDERS[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns) and cells(mine) == cells(theirs)


def test_pii_digest(spark, sf, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.BUILDERS["op3_pii"](spark, sf).collect():
        base = literal(texts.pop(r.doc_id) or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert not texts


def test_quality_digest(spark, sf, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.BUILDERS["op10_quality"](spark, sf).collect():
        assert tuple(r)[1:7] == brute(texts.pop(r.doc_id))
        assert not (r.base_failed and r.kept)
    assert not texts


@pytest.mark.parametrize(("name", "fold"), [("op4_language", (3, 1)), ("op5_toxicity", (5, 0))])
def test_scores(spark, sf, con, name, fold):
    ids = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
    for r in queries.BUILDERS[name](spark, sf).collect():
        ids.remove(r.doc_id)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1
    assert not ids
