"""Decision rules at their edges: zero sums, thresholds at or below zero, dates reached, layers of orphans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as dc, portfolio as pf, quality as ql
from tidemark.sources import readers as rd


def test_zero_sums_do_not_end_the_job(spark):
    rows = [("a", "x", 0.0, "Tech", ""), ("a", "y", 0.0, "Tech", "t"), ("b", "z", 0.0, None, "")]
    out = dc.apply_limits(spark.createDataFrame(rows, "account_id string, symbol string, target_pct double, sector string, thesis string")).collect()
    assert [r.limited_pct for r in out] == [0.0, 0.0, 0.0]
    free = dc.buying_power_scale(spark.createDataFrame([("a", 0.0, 5.0)], "account_id string, cost double, cash double")).first()
    assert free.scaled_cost == 0.0
    assert spark.range(1).select(ql.ambiguity_band(F.lit(1.0), 0.0).alias("x")).first().x is None


@pytest.mark.parametrize(("op", "threshold", "value", "want"), [
    ("<", -0.5, -0.1, "FAR"), ("<", -0.5, -0.45, "NEAR"), ("<", -0.5, -0.6, "TRIGGERED"), (">", -1.0, -1.1, "NEAR"), (">", -1.0, -5.0, "FAR"), ("<", 0.0, 0.1, "FAR"), ("<", 0.0, -0.1, "TRIGGERED"),
    (">", 10.0, 9.0, "NEAR"), ("<", 10.0, 12.0, "NEAR"), ("<", 10.0, 15.0, "APPROACHING"), (">", 10.0, -3.0, "FAR"),
])
def test_proximity_on_either_side_of_zero(spark, op, threshold, value, want):
    monthly = spark.createDataFrame([("e", dt.date(2024, 1, 31), "S", value)], "entity_id string, month date, series_id string, value double")
    assert dc.kill_switches([("r", "S", op, threshold, 1)], monthly).first().proximity == want


def test_orphans_by_layer(spark):
    both = spark.createDataFrame([("a", s, 0.0, 4.0, -4.0, layer) for s, layer in (("1", "regime"), ("2", "thesis_tactical"), ("3", "old"))], "account_id string, symbol string, target_pct double, current_pct double, delta_pct double, layer string")
    got = {r.symbol: r.action for r in dc.reconcile(both, F.lit(False), F.col("layer")).collect()}
    assert got == {"1": "SELL_SOME", "2": "CLOSE", "3": "REVIEW"}


def test_review_date_reached_expires(spark):
    rows = [("t", "INTACT", False, False, dt.date(2024, 1, 31))]
    facts = spark.createDataFrame(rows, "k string, status string, trigger_met boolean, kill boolean, review_date date")
    assert dc.thesis_status(facts, "k", "2024-01-31").first().next_status == "TIME EXPIRED"
    assert dc.thesis_status(facts, "k", "2024-01-30").first().next_status == "ACTIVE"


def test_cross_rate_through_an_inverse_leg(spark):
    fx = spark.createDataFrame([("USD", "JPY", 150.0), ("USD", "CHF", 0.9)], "src string, dst string, rate double")
    rates = {r.currency: r.rate for r in pf.resolve_rates(fx, "CHF").collect()}
    assert rates["JPY"] == pytest.approx(0.9 / 150)


def test_only_a_pending_order_makes_a_duplicate(spark):
    rows = [(1, "2024-01-01 10:00:00", "a", "filled"), (2, "2024-01-01 11:00:00", "a", "open"), (3, "2024-01-01 12:00:00", "a", "filled"), (4, "2024-01-02 12:00:00", "a", "open")]
    orders = spark.createDataFrame(rows, "id int, ts string, k string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.duplicate for r in pf.duplicate_orders(orders, ["k"], "ts", "id", pending=F.col("status") == "open").collect()}
    assert got == {1: False, 2: False, 3: True, 4: False}


def test_distributions_are_told_apart(spark):
    rows = [("e", 1, "a", 0.5, 0.5), ("e", 1, "a", 0.5, 0.5), ("e", 1, "b", 0.7, 0.5)]
    out = ql.forecast_sanity(spark.createDataFrame(rows, "entity_id string, horizon int, source string, prob double, base_rate double"), keys=("entity_id", "horizon", "source")).collect()
    assert sorted((r.source, r.bad_total) for r in out) == [("a", False), ("a", False), ("b", True)]


def test_period_keys_are_positions(spark, tmp_path):
    doc = '{"data": {"structure": {"dimensions": {"series": [{"id": "REF_AREA", "values": [{"id": "X"}]}], "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2024-02"}, {"id": "2024-01"}]}]}}, "dataSets": [{"series": {"0:0": {"observations": {"0": [2.0], "1": [1.0]}}}}]}}'
    (tmp_path / "a.json").write_text(doc)
    assert {r.period: r.value for r in rd.read_sdmx_json(spark, str(tmp_path)).collect()} == {"2024-02": 2.0, "2024-01": 1.0}
