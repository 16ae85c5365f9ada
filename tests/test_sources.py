"""Landed files in their native shape: whole documents, lists, broken lines."""

import json

from pyspark.sql import functions as F

from tidemark.config import TEMPLATES
from tidemark.sources import readers as rd, sinks as sk


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_sdmx_json_both_layouts(spark, tmp_path):
    dims = {
        "series": [{"id": "REF_AREA", "values": [{"id": "USA"}, {"id": "JPN"}]}],
        "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2020-02"}, {"id": "2020-01"}]}],
    }
    body = {"structure": {"dimensions": dims}, "dataSets": [{"series": {"1:0:0": {"observations": {"0": [1.5, 0], "1": [2.5]}}}}]}
    put(tmp_path / "a.json", json.dumps({"data": body}, indent=1))
    rows = {(r.area, r.period): r.value for r in rd.read_sdmx_json(spark, str(tmp_path), sort_periods=True).collect()}
    assert rows == {("JPN", "2020-01"): 1.5, ("JPN", "2020-02"): 2.5}
    put(tmp_path / "b" / "b.json", json.dumps(body))
    plain = {(r.area, r.period): r.value for r in rd.read_sdmx_json(spark, str(tmp_path / "b")).collect()}
    assert plain == {("JPN", "2020-02"): 1.5, ("JPN", "2020-01"): 2.5}


def test_json_stat(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"label": "x", "value": {"0": 1.0, "2": 3.0}, "dimension": {"time": {"category": {"index": {"2020": 0, "2021": 1, "2022": 2}}}}}, indent=1))
    assert {r.period: r.value for r in rd.read_json_stat(spark, str(tmp_path)).collect()} == {"2020": 1.0, "2022": 3.0}


def test_bulk_series(spark, tmp_path):
    lines = [
        json.dumps({"series_id": "A", "data": [["20200110", 3], ["20200103", None], ["20191227", "x"], ["20191220", 1.5]]}),
        json.dumps({"series_id": "B", "data": [["20200110", 9]]}),
        '{"series_id": "A", broken',
        "",
    ]
    put(tmp_path / "bulk.txt", "\n".join(lines))
    out = rd.read_bulk_series(spark, str(tmp_path), ["A"]).orderBy("obs_date").collect()
    assert [(str(r.obs_date), r.value) for r in out] == [("2019-12-20", 1.5), ("2020-01-10", 3.0)]
    assert rd.read_bulk_series(spark, str(tmp_path), ["A"], last=1).count() == 1


def test_country_years_and_meta_records(spark, tmp_path):
    put(tmp_path / "w" / "a.json", json.dumps({"values": {"GDP": {"USA": {"2024": 2.0, "2025": 2.5}}}}))
    assert {(r.country, r.year): r.value for r in rd.read_country_years(spark, str(tmp_path / "w")).collect()} == {("USA", 2024): 2.0, ("USA", 2025): 2.5}
    put(tmp_path / "m" / "a.json", json.dumps([{"pages": 2}, [{"country": {"id": "US"}, "date": "2020", "value": 1.0}, {"country": {"id": "US"}, "date": "2021", "value": None}]], indent=1))
    rows = rd.read_meta_records(spark, str(tmp_path / "m")).collect()
    assert [(r.country, r.year, r.value, r.truncated) for r in rows] == [("US", 2020, 1.0, True)]


def test_snapshot_folder(spark, tmp_path):
    snap = lambda day, v: json.dumps({"timestamp": f"2024-01-{day}T00:00:00Z", "account": {"account_id": "a", "portfolio_value": v, "cash": 1.0}, "positions": [{"symbol": "SPY", "qty": 2.0, "market_value": 5.0, "unrealized_pl": 0.5}]}, indent=1)
    put(tmp_path / "2024-01-01-snapshot.json", snap("01", 10.0))
    put(tmp_path / "2024-01-02-snapshot.json", snap("02", 11.0))
    put(tmp_path / "latest-snapshot.json", snap("02", 11.0))
    put(tmp_path / "other.json", "{}")
    snaps = rd.read_snapshots(spark, str(tmp_path))
    accounts, plain, results = rd.account_tables(snaps)
    assert accounts.count() == 2 and "unrealized_pl" not in plain.columns and results.agg(F.sum("unrealized_pl")).first()[0] == 1.0


def test_trade_logs_mixed_files(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps({"symbol": "SPY", "qty": 1.0}))
    put(tmp_path / "b.json", json.dumps([{"symbol": "TLT", "qty": 2.0}, {"symbol": "GLD", "qty": 3.0}], indent=1))
    put(tmp_path / "c.json", "{broken")
    assert sorted(r.symbol for r in rd.read_trade_logs(spark, str(tmp_path)).collect()) == ["GLD", "SPY", "TLT"]


def test_run_log_counts_broken_lines(spark, tmp_path):
    put(tmp_path / "log.jsonl", '{"ts": "1", "severity": "INFO", "details": {"a": "b"}}\n\n{broken\n{"ts": "2", "severity": "WARN"}\n')
    good, bad = rd.read_run_log(spark, str(tmp_path))
    assert good.count() == 2 and bad.first().malformed == 1


def test_templates(spark, tmp_path):
    doc = {"_note": "x", "Goldilocks": {"_description": "d", **{b: {"etf": s, "weight": w} for b, s, w in TEMPLATES["Goldilocks"]}, "_total": 95}, "Bad": {"x": {"etf": "A", "pct": 50}, "_total": 95}}
    put(tmp_path / "t.json", json.dumps(doc, indent=1))
    rows, totals = rd.read_templates(spark, str(tmp_path))
    assert rows.where("family = 'Goldilocks'").count() == len(TEMPLATES["Goldilocks"])
    assert {r.family: r.matches for r in totals.collect()} == {"Goldilocks": True, "Bad": False}


def test_observations_drop_nan_and_null(spark, tmp_path):
    put(tmp_path / "o.csv", "A,S,2020-01-31,1.5\nA,S,2020-02-29,NaN\nA,S,2020-03-31,\n")
    assert rd.read_observations(spark, str(tmp_path), "csv").count() == 1


def test_documents_keep_stem(spark, tmp_path):
    put(tmp_path / "ACTIVE-x.md", "# T\n\nbody\n")
    row = rd.read_documents(spark, str(tmp_path)).first()
    assert row.doc_id == "ACTIVE-x" and row.text.startswith("# T\n\nbody")


def test_dated_rerun_replaces_only_its_date(spark, tmp_path):
    path = str(tmp_path / "t")
    sk.write_dated(spark.range(3), path, "2024-01-01")
    sk.write_dated(spark.range(5), path, "2024-01-02")
    sk.write_dated(spark.range(2), path, "2024-01-02")
    assert spark.read.parquet(path).count() == 5 and sk.read_latest(spark, path).count() == 2


def test_upsert_keeps_old_confidence(spark):
    old = spark.createDataFrame([("w1", "G", "High"), ("w2", "S", "High")], "week STRING, regime STRING, confidence STRING")
    new = spark.createDataFrame([("w2", "O"), ("w3", "O")], "week STRING, regime STRING")
    rows = {r.week: (r.regime, r.confidence) for r in sk.upsert_history(old, new, ["week"], {"confidence": "Backfilled"}).collect()}
    assert rows == {"w1": ("G", "High"), "w2": ("O", "High"), "w3": ("O", "Backfilled")}


def test_snapshot_folder_leaves_copies_and_other_files_out(spark, tmp_path):
    body = '{{"timestamp": "2024-01-0{0}T00:00:00Z", "account": {{"account_id": "a", "portfolio_value": {0}.5}}, "positions": []}}'
    for name, n in (("2024-01-01-snapshot.json", 1), ("2024-01-02-snapshot.json", 2), ("latest-snapshot.json", 2), ("other.json", 3)):
        (tmp_path / name).write_text(body.format(n))
    got = {(r.file, r.account.portfolio_value) for r in rd.read_snapshots(spark, str(tmp_path)).collect()}
    assert got == {("2024-01-01-snapshot.json", 1.5), ("2024-01-02-snapshot.json", 2.5)}


def test_trade_logs_of_objects_lists_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"symbol": "X", "qty": 1.0}')
    (tmp_path / "b.json").write_text('[{"symbol": "Y", "qty": 2.0},\n {"symbol": "Z", "qty": 3.0}]')
    (tmp_path / "c.json").write_text('{"symbol": "broken", ')
    assert sorted((r.symbol, r.qty) for r in rd.read_trade_logs(spark, str(tmp_path)).collect()) == [("X", 1.0), ("Y", 2.0), ("Z", 3.0)]


def test_documents_are_named_by_their_files(spark, tmp_path):
    (tmp_path / "one.v2.md").write_text("# A\n\nb")
    (tmp_path / "two.md").write_text("")
    assert {r.doc_id: r.text for r in rd.read_documents(spark, str(tmp_path)).collect()}["one.v2"] == "# A\n\nb"


def test_prices_without_a_close_are_dropped(spark, tmp_path):
    rows = [("a", "2024-01-01", 1.0, 2), ("a", "2024-01-02", None, 2), ("a", "2024-01-03", float("nan"), 2)]
    spark.createDataFrame(rows, "asset_id string, price_date string, close double, volume long").selectExpr("asset_id", "date(price_date) AS price_date", "close", "volume").write.parquet(str(tmp_path / "p"))
    assert [r.close for r in rd.read_prices(spark, str(tmp_path / "p")).collect()] == [1.0]
