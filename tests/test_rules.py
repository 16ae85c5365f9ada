"""Nested schema rules, the layered retry gate, and account scans with one account that holds a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import decisions as dc, portfolio as pf, quality as ql, transitions as tr

RULES = (
    ql.Rule("name", filled=True),
    ql.Rule("tags", "array", filled=True, stub="text", fields=(ql.Rule("text", present=True), ql.Rule("state", required=False, values=("on", "off")))),
    ql.Rule("plan", "object", fields=(ql.Rule("exit"), ql.Rule("steps", "array", of_class="big"))),
    ql.Rule("risk", "object", stub="main", any_of=("counter", "list"), of_class="big"),
)
GOOD = '{"name": "a", "tags": [{"text": "x", "state": "on"}, {"text": null, "state": "off"}], "plan": {"exit": "e", "steps": []}, "risk": {"list": [1]}}'


@pytest.mark.parametrize(
    ("record", "of", "want"),
    [
        (GOOD, "big", {"tags[1].text is missing"}),
        ('{"name": " ", "tags": [], "plan": []}', "", {"name is empty", "tags is empty", "plan must be object, got array"}),
        ('{"name": true, "tags": "t", "plan": {"exit": 1}}', "", {"name must be string, got boolean", "tags must be array, got string", "plan.exit must be string, got number"}),
        ('{"tags": [7, {"text": "x", "state": "odd"}], "plan": {"exit": "e"}}', "big", {"name is missing", "tags[0] must be object, got number", "tags[1].state is not a valid value: odd", "plan.steps is missing", "risk is missing"}),
        ('{"name": "a", "tags": [{"text": "See Document 4"}], "plan": {"exit": "e", "steps": [1]}, "risk": {"main": "see document", "counter": "  "}}', "big", {"tags holds a placeholder", "risk holds a placeholder", "risk has neither counter nor list"}),
        ("[1]", "big", {"record is no object"}),
        ("{broken", "", {"record is no object"}),
        (None, None, {"record is no object"}),
    ],
)
def test_nested_rules(spark, record, of, want):
    df = spark.createDataFrame([(1, record, of)], "id int, record string, of string")
    assert {r.violation for r in ql.record_violations(df, "record", RULES, F.col("of"), ["id"]).collect()} == want


@pytest.mark.parametrize(
    ("count", "side", "layer", "signal", "status", "priority", "gate"),
    [
        (0, "buy", "regime", "avoid", None, 3, "retry"), (2, "buy", "regime", "neutral", None, 3, "skip"), (2, "buy", "regime", "bull", None, 3, "retry"), (2, "sell", "regime", "bear", None, 3, "market"),
        (2, "buy", "regime", "bear", None, 3, "skip"), (0, "sell", "regime", "bull", None, 1, "market"), (5, "buy", "thesis_tactical", "bull", "WEAKENING", 4, "skip"), (5, "buy", "thesis_structural", "bear", "ACTIVE", 4, "retry"),
        (3, "sell", "thesis_tactical", None, "APPROACHING", None, "skip"), (2, "sell", "regime", None, None, None, "skip"), (0, "buy", "regime", None, None, 1, "retry"),
    ],
)
def test_retry_gate_by_side_and_layer(spark, count, side, layer, signal, status, priority, gate):
    schema = "retry_count long, side string, layer string, signal string, status string, priority int"
    row = dc.layered_retry_gate(spark.createDataFrame([(count, side, layer, signal, status, priority)], schema)).first()
    assert row.gate == gate and (row.widen_pct is not None) == (gate == "retry")


def accounts(spark, n=1500):
    rng = np.random.default_rng(8)
    keys = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 20, n).astype(str))
    rows = [(str(k), f"s{i}", float(rng.integers(-9, 9)), int(rng.integers(0, 50)), float(rng.random()), "structural" if rng.random() < 0.3 else "other") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "account_id string, symbol string, gain double, size int, turnover_pct double, layer string")


def test_best_and_worst_of_a_hot_account(spark):
    df = accounts(spark)
    w = Window.partitionBy("account_id")
    want = df.select("symbol", F.row_number().over(w.orderBy(F.desc("gain"), "symbol")).alias("rank"), (F.row_number().over(w.orderBy("gain", "symbol")) <= 3).alias("worst_three"))
    got = pf.best_and_worst(df, "account_id", "gain", "symbol").select("symbol", "rank", "worst_three")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.where("rank <= 5 OR worst_three").collect()))


def test_budget_of_a_hot_account_equals_plain_windows(spark):
    df = accounts(spark)
    got = {r.symbol: (r.reserved, r.decision) for r in dc.allocate_budget(df, "account_id", ["size", "symbol"], F.col("layer") == "structural").collect()}
    for key in {r.account_id for r in df.select("account_id").distinct().collect()}:
        rows = sorted(df.where(F.col("account_id") == key).collect(), key=lambda r: (r["size"], r.symbol))
        total, reserved = 0.0, set()
        for r in rows:
            if r.layer == "structural":
                total += r.turnover_pct
                if total <= 5:
                    reserved.add(r.symbol)
        left = sum(r.turnover_pct for r in rows if r.symbol in reserved)
        for r in rows:
            if r.symbol not in reserved:
                left += r.turnover_pct
            assert got[r.symbol] == (r.symbol in reserved, "execute" if r.symbol in reserved or left <= 25 else "skip")


def test_all_labels_of_a_sample_count(spark):
    """The 30th label is the first with a liquidity side; the eight-part statistics need it."""
    rows = [("e", i, "Goldilocks", "Goldilocks — Ample Liquidity" if i == 30 else "Goldilocks") for i in range(40)] + [("f", i, "Goldilocks", "Goldilocks") for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, i int, regime string, regime_8 string").withColumn("month", F.expr("date_add(date'2020-01-01', 31 * i)"))
    sampled = tr.sample_windows(df, ["entity_id"], "month", "2022-01-01")
    assert {(r.entity_id, r.valid_8) for r in sampled.select("entity_id", "valid_8").distinct().collect()} == {("e", True), ("f", False)}
    found = tr.by_label_set(sampled, lambda rows, label: tr.frequency(rows, ["entity_id", "sample"], label))
    assert {(r.entity_id, r["sample"], r.label_set) for r in found.collect()} == {("e", "full", 4), ("e", "recent", 4), ("e", "full", 8), ("e", "recent", 8), ("f", "full", 4), ("f", "recent", 4)}


def test_ranks_of_the_worst_count_ties_and_nulls(spark):
    rows = [("a", f"s{i:02d}", g) for i, g in enumerate([5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 9.0, 1.0, 1.0, None])] + [("b", "s", 0.0)]
    df = spark.createDataFrame(rows, "account_id string, symbol string, gain double")
    down = sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[2] is not None, -(r[2] or 0), r[1]))
    up = sorted((r for r in rows if r[0] == "a"), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
    want = {(*r, i + 1, r in up[:3]) for i, r in enumerate(down) if i < 2 or r in up[:3]} | {("b", "s", 0.0, 1, True)}
    out = pf.best_and_worst(df, "account_id", "gain", "symbol", best=2, worst=3)
    assert {tuple(r) for r in out.collect()} == want
    # Nothing but the few best and worst rows of each task and the counts is shuffled: no account is sorted as a whole.
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_positions_write_only_what_is_read(spark, sf):
    from tidemark.plans import bindings as b

    assert "positions-" not in "".join(b.positions(spark, sf, "account_id", "symbol").inputFiles())
    some = b.positions(spark, sf, "symbol", "allocation_pct")
    written = [f for f in some.inputFiles() if "positions-" in f]
    assert some.columns == ["symbol", "allocation_pct"] and set(spark.read.parquet(*written).columns) == {"account_id", "symbol", "market_value", "cash"}


def test_records_are_dealt_to_tasks_and_fields_taken_out_once(spark):
    from tidemark.operators import quality as ql

    df = spark.createDataFrame([(1, '{"n": 3}')], "id int, r string").coalesce(1)
    out = ql.record_violations(df, "r", [ql.Rule("n")], F.lit(""), ["id"])
    assert [r.violation for r in out.collect()] == ["n must be string, got number"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and plan.count("$.n") <= 2
