"""Keyed state of streams: scans and sessions by hand with a stand-in for Spark's state, and the keyed table on files."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from tidemark.streaming import jobs, state

HOUR = 3_600_000


class Cell:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.cells, self.timers = {}, set()

    def getValueState(self, name, _):  # noqa: N802
        return self.cells.setdefault(name, Cell())

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def scan_in_parts(processor, parts, delay):
    """Feed parts of rows one after the other; the newest result of every row, and the longest list that was kept."""
    handle, latest, most, mark = Handle(), {}, 0, 0
    processor.init(handle)
    for part in parts:
        for frame in processor.handleInputRows(("k",), iter([part[::2], part[1::2]]), At(mark)):
            latest |= {r[state.MS]: r for r in frame.to_dict("records")}
        most = max(most, len(handle.cells["open"].held or []))
        mark = max(mark, int(part[state.MS].max()) - delay)
    return latest, most


def parts_with_late_rows(rng, n, size, delay):
    ms = np.arange(n) * 1000 + 10
    rows = pd.DataFrame({state.MS: ms, "v": np.where(rng.random(n) < 0.1, np.nan, rng.normal(1e6, 5, n).round(2))})
    comes = ms + np.where(rng.random(n) < 0.2, rng.integers(0, delay, n), 0)
    return rows, [rows[comes // (size * 1000) == i] for i in range(int(comes.max() // (size * 1000)) + 1)]


@pytest.mark.parametrize("late", [1, 4000])
def test_scans_with_late_rows_equal_one_pass(late):
    rows, parts = parts_with_late_rows(np.random.default_rng(3), 400, 20, late)
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([T.StructField(state.MS, long), T.StructField("v", double)])
    got, most = scan_in_parts(state.OrderedScan(["k"], [], schema, None, state.Moments("v", 5)), [p for p in parts if len(p)], late)
    seen = []
    for r in rows.to_dict("records"):
        mine = got[r[state.MS]]
        assert mine["baseline_n"] == len(seen)
        want = (r["v"] - np.mean(seen)) / np.std(seen) if len(seen) >= 5 else np.nan
        assert np.isclose(mine["z"], want, rtol=1e-6, equal_nan=True)
        seen += [] if np.isnan(r["v"]) else [r["v"]]
    # State follows the delay and the size of a part, not the number of rows.
    assert most <= 20 + 2 * (late // 1000) + 2

    signed = rows.assign(v=np.nan_to_num(rows["v"] - 1e6) * 400)
    lookup = dict(zip(signed[state.MS], signed["v"], strict=True))
    got, _ = scan_in_parts(state.OrderedScan(["k"], [], schema, None, state.Drawdown("v")), [p.assign(v=[lookup[m] for m in p[state.MS]]) for p in parts if len(p)], late)
    value = (signed["v"].cumsum() + 100000).round(2)
    high = value.cummax()
    for m, v, h in zip(signed[state.MS], value, high, strict=True):
        assert abs(got[m]["portfolio_value"] - v) < 0.011 and abs(got[m]["drawdown_pct"] - (h - v) / h * 100) < 1e-4


def log(*entries):
    return pd.DataFrame([(h * HOUR, severity, phase) for h, severity, phase in entries], columns=[state.MS, "severity", "phase"])


def test_a_session_is_emitted_when_opened_changed_joined_and_closed():
    p, handle = state.LogSessions("run", 6 * HOUR), Handle()
    p.init(handle)
    feed = lambda rows, mark=0: [(r.start // HOUR, r.events, r.warn, r.ended, r.status) for f in p.handleInputRows(("a",), iter([rows]), At(mark)) for r in f.itertuples()]
    assert feed(log((1, "INFO", "run-start"), (3, "WARN", "work"))) == [(1, 2, 1, False, "open")]
    assert feed(log((13, "INFO", "run-start"))) == [(13, 1, 0, False, "open")]
    assert handle.timers == {9 * HOUR, 19 * HOUR}
    # A late row joins both; the second start is none any more. A gap of six hours exactly parts two sessions.
    assert feed(log((8, "ERROR", None), (19, "INFO", "run-end"))) == [(1, 4, 1, False, "open"), (19, 1, 0, True, "open"), (13, 1, 0, False, "joined")]
    assert handle.timers == {19 * HOUR, 25 * HOUR}
    closed = [r for f in p.handleExpiredTimer(("a",), None, At(19 * HOUR)) for r in f.itertuples()]
    assert [(r.start // HOUR, r.events, r.error, r.status) for r in closed] == [(1, 4, 1, "closed")] and len(handle.cells["open"].held) == 1
    assert [r.ended for f in p.handleExpiredTimer(("a",), None, At(25 * HOUR)) for r in f.itertuples()] == [True]
    assert not handle.cells["open"].exists()


class Calls(Cell):
    """Counts the calls to the state."""

    made = 0

    def _count(self, call, *args):
        Calls.made += 1
        return call(*args)

    def exists(self):
        return self._count(super().exists)

    def get(self):
        return self._count(super().get)

    def put(self, value):
        self._count(super().update, value)


class CountingHandle(Handle):
    def getListState(self, name, _):  # noqa: N802
        return self.cells.setdefault(name, Calls())


def test_keys_of_a_bucket_are_scanned_together(monkeypatch):
    rng = np.random.default_rng(8)
    streams = {k: parts_with_late_rows(rng, 60, 20, 3000) for k in ("a", "b", None, "d")}
    fields = [T.StructField("k", T.StringType()), T.StructField(state.MS, T.LongType()), T.StructField("v", T.DoubleType())]
    for scan in (state.Moments("v", 5), state.Drawdown("v")):
        monkeypatch.setattr(Calls, "made", 0)
        one, handle, got = state.OrderedScan(["k"], [], T.StructType(fields), None, scan), CountingHandle(), {}
        one.init(handle)
        rounds = max(len(parts) for _, parts in streams.values())
        for i in range(rounds):
            part = pd.concat([parts[i].assign(k=k) for k, (_, parts) in streams.items() if i < len(parts)])
            mark = max(0, i * 20000 + 10 - 3000)
            for frame in one.handleInputRows((7,), iter([part[::2], part[1::2]]), At(mark)):
                got |= {(None if pd.isna(r["k"]) else r["k"], r[state.MS]): r for r in frame.to_dict("records")}
        # Two lists read and written a round, whatever the number of keys.
        assert Calls.made <= 6 * rounds
        for k, (rows, _) in streams.items():
            out, _ = scan(np.zeros(len(rows), int), [np.array([x]) for x in scan.empty], rows)
            for name, column in out.items():
                assert np.allclose([got[k, m][name] for m in rows[state.MS]], column, rtol=1e-6, atol=1e-6, equal_nan=True), (k, name)


def test_sessions_of_a_bucket_share_one_timer():
    p, handle = state.LogSessions("run", 6 * HOUR, T.StringType()), CountingHandle()
    p.init(handle)
    feed = lambda rows, mark=0: sorted((r.run, r.start // HOUR, r.events, r.status) for f in p.handleInputRows((3,), iter([rows]), At(mark)) for r in f.itertuples())
    runs = lambda names, frame: frame.assign(run=list(names))
    assert feed(runs("abab", log((1, "INFO", None), (2, "INFO", None), (3, "WARN", None), (30, "INFO", "run-end")))) == [("a", 1, 2, "open"), ("b", 2, 1, "open"), ("b", 30, 1, "open")]
    assert handle.timers == {8 * HOUR}
    # Only what changed is emitted again; the late row of b joins nothing of a.
    assert feed(runs("bc", log((7, "INFO", None), (40, "INFO", None)))) == [("b", 2, 2, "open"), ("c", 40, 1, "open")]
    assert handle.timers == {9 * HOUR}
    closed = lambda due, mark: sorted((r.run, r.start // HOUR, r.events, r.status) for f in p.handleExpiredTimer((3,), At(mark), At(due)) for r in f.itertuples())
    handle.timers.clear()
    assert closed(9 * HOUR, 20 * HOUR) == [("a", 1, 2, "closed"), ("b", 2, 2, "closed")]
    assert handle.timers == {36 * HOUR}
    handle.timers.clear()
    assert closed(36 * HOUR, 90 * HOUR) == [("b", 30, 1, "closed"), ("c", 40, 1, "closed")]
    assert not handle.timers and not handle.cells["open"].exists()


def test_stream_of_sessions_keeps_open_ones_and_survives_restarts(spark, tmp_path):
    day = dt.datetime(2024, 3, 1)
    rows = [("a", 0, "run-start"), ("a", 5, "run-end"), ("a", 40, "run-start"), ("b", 38, "run-start"), ("b", None, "lost")]
    late = [("a", 30, "work"), ("b", 41, "run-end"), ("c", 60, "work")]
    for part in (rows, late):
        entries = [(r, None if h is None else day + dt.timedelta(hours=h), "INFO", phase) for r, h, phase in part]
        spark.createDataFrame(entries, "run STRING, ts TIMESTAMP, severity STRING, phase STRING").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("run STRING, ts TIMESTAMP, severity STRING, phase STRING").parquet(f"{tmp_path}/in")
        jobs.run_available(state.log_sessions(stream, "run", "ts", 6, "12 hours"), jobs.updates_job(f"{tmp_path}/out"), f"{tmp_path}/cp")
    got = jobs.current_rows(spark, f"{tmp_path}/out", ["run", "start"]).where("status <> 'joined'")
    found = sorted((r.run, int((r.start - day).total_seconds() // 3600), r.events, r.incomplete, r.status) for r in got.collect())
    assert found == [("a", 0, 2, False, "closed"), ("a", 30, 1, True, "closed"), ("a", 40, 1, True, "closed"), ("b", 38, 2, False, "closed"), ("c", 60, 1, True, "open")]


def test_upsert_writes_what_the_batch_touches(spark, tmp_path):
    root = str(tmp_path / "table")
    job = jobs.upsert_job(root, ["k"], ["at"], buckets=16)
    rows = lambda *r: spark.createDataFrame(list(r), "k STRING, at BIGINT, word STRING")
    job(rows(*[(f"k{i}", 1, "old") for i in range(100)]), 0)
    job(rows(("k7", 2, "new"), ("k8", 0, "late"), ("x", 1, "fresh")), 1)
    job(rows(("k7", 2, "new"), ("k8", 0, "late"), ("x", 1, "fresh")), 1)
    got = {r.k: r.word for r in jobs.keyed_table(spark, root).collect()}
    assert len(got) == 101 and got["k7"] == "new" and got["k8"] == "old" and got["x"] == "fresh" and got["k9"] == "old"
    written = spark.read.parquet(f"{root}/v=1").select("_bucket").distinct().count()
    assert written <= 3 and spark.read.parquet(f"{root}/v=0").select("_bucket").distinct().count() > 10
