"""Registered queries against their SQL, and the shape of their plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.operators import regime
from tidemark.plans import bindings, load
from tools.check import cells

QUICK = (
    "aligned_indicators", "regimes", "expanding_rank", "transition_counts", "asof_nearest_prices", "series_cards", "z_scores", "range_anomalies",
    "snapshot_returns", "rolling_win_rate", "exposure", "fx_rates", "reconciliation", "risk_limits", "fifo_matches", "theme_persistence", "similar_vectors",
    "document_sections", "canonical_rows", "numbered_items", "code_mentions", "run_log_summary", "bulk_series", "stream_drawdown", "stream_confirmation", "stream_baseline", "stream_log_sessions", "stream_weekly_dedup",
)
NAMES = sorted(load()) if os.environ.get("TIDEMARK_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    q = load()[name]
    mine = q.build(spark, sf).toPandas()
    if q.oracle is None:
        assert len(mine) > 0
        return
    theirs = con.execute(q.oracle).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert cells(mine) == cells(theirs)


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_declared_double_exists():
    for q in load().values():
        assert len(set(q.doubles)) == len(q.doubles), q.name


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["regimes", "transition_counts", "series_cards", "exposure", "risk_limits", "z_scores", "document_sections"])
def test_no_single_partition_and_no_cross_join(spark, sf, name):
    text = plan(load()[name].build(spark, sf))
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filter_pushed(spark, sf):
    from tidemark.operators import quality as ql

    text = plan(ql.select_series(bindings.table(spark, sf, "orders").selectExpr("o_orderpriority AS series_id", "o_totalprice"), ["2-HIGH"]).select("o_totalprice"))
    assert "o_orderdate" not in text.split("ReadSchema")[1] and "2-HIGH" in text.split("PushedFilters")[1]


def test_capped_queue_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(load()["capped_queue"].build(spark, sf))


def test_entities_are_independent(spark, sf):
    obs = bindings.observations(spark, sf, "region")
    cols = ["month", "regime", "regime_8", "growth_score"]
    together = regime.classify(obs).where("entity_id = '2'").select(*cols).orderBy("month").collect()
    alone = regime.classify(obs.where("entity_id = '2'").repartition(7)).select(*cols).orderBy("month").collect()
    assert together == alone and len(together) > 20
