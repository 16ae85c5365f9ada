"""Keyed state of streams, kept by Spark's state store: scans in event order and sessions of a log.

Rows of a key may arrive late by up to the watermark's delay. A scan keeps one settled value per key, for all rows the watermark
has passed, and the rows since then; a session keeps its totals and a timer. So state is bounded by the delay and by the open
sessions, not by the events. Keys are dealt into buckets, and a bucket's keys are read, advanced and written together. Both write updates: the newest one of a row or session is its current value, see
:func:`tidemark.streaming.jobs.current_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import LIMITS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Name of the event time in milliseconds that every stateful stream carries.
MS = "event_ms"
Scan = Callable[[np.ndarray, list[np.ndarray], pd.DataFrame], tuple[dict[str, np.ndarray], list[np.ndarray]]]
#: Keys dealt into this many buckets share a state, so the calls to the state store follow the buckets and not the keys.
BUCKETS = 128


def use_state_store(spark: SparkSession) -> None:
    """The state API needs the provider that keeps several states per key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with its event time in milliseconds and a watermark on it; rows without a time take no part."""
    known = stream.withColumn("event_at", F.col(time).cast("timestamp")).where(F.col("event_at").isNotNull())
    return known.withWatermark("event_at", delay).withColumn(MS, F.unix_millis("event_at"))


def bucketed(stream: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The stream with the bucket of its keys."""
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _held(state) -> list[tuple]:
    return [tuple(row) for row in state.get()] if state.exists() else []


def _plain(frame: pd.DataFrame) -> list[tuple]:
    """Rows as tuples of plain values, missing ones as null."""
    return list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@dataclass
class OrderedScan(StatefulProcessor):
    """A scan over the rows of each key in event order that late rows are put into.

    A state is one key's, or a bucket's whose rows hold ``keys``; all its keys are scanned at once. ``scan(part, settled, rows)``
    gets rows ordered by key, the number of each row's key and the settled value of every key; it returns the output columns
    of the rows and, per part of the state, its value after each row. When rows arrive, the open rows are scanned again together
    with them, and a key's results from its first new row on are emitted: rows that came in order once, later ones again with
    their corrected values.
    """

    keys: list[str]
    order: list[str]
    rows: T.StructType
    settled: T.StructType
    scan: Scan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getListState("settled", self.settled)
        self.open = handle.getListState("open", self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.rows.names
        inner = [k for k in self.keys if k in names]
        new = pd.concat([frame[names] for frame in rows]).assign(fresh=True)
        kept = _held(self.open)
        old = pd.DataFrame(kept, columns=names).assign(fresh=False)
        every = pd.concat([old, new], ignore_index=True) if kept else new.reset_index(drop=True)
        every = every.assign(_part=every.groupby(inner, dropna=False, sort=False).ngroup() if inner else 0)
        every = every.sort_values(["_part", MS, *self.order], ignore_index=True)
        part = every["_part"].to_numpy()
        heads = _plain(every[inner].iloc[np.flatnonzero(np.diff(part, prepend=-1))]) if inner else [()]
        known = {row[: len(inner)]: row[len(inner) :] for row in _held(self.now)}
        state = [np.array(column) for column in zip(*[known.get(k, self.scan.empty) for k in heads], strict=True)]
        out, after = self.scan(part, state, every)
        # All that the watermark has passed becomes one settled value of its key.
        passed = every[MS].to_numpy() <= timerValues.getCurrentWatermarkInMs()
        if passed.any():
            last = np.flatnonzero(passed & np.append((part[1:] != part[:-1]) | ~passed[1:], True))
            known |= zip([heads[i] for i in part[last]], zip(*[column[last].tolist() for column in after], strict=True), strict=True)
            self.now.put([(*k, *value) for k, value in known.items()])
        rest = every.loc[~passed, names]
        if len(rest):
            self.open.put(_plain(rest))
        elif kept:
            self.open.clear()
        changed = every.groupby("_part")["fresh"].cummax().to_numpy(bool)
        frame = pd.concat([every[names], pd.DataFrame(out)], axis=1)[changed]
        yield frame if inner else frame.assign(**dict(zip(self.keys, key, strict=True)))


def ordered_scan(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], settled: str, outputs: str, scan: Scan, buckets: int = BUCKETS) -> DataFrame:
    """Updates of ``keys``, ``columns``, the event time in milliseconds and ``outputs``; ``stream`` comes from :func:`timed`.

    ``order`` breaks ties of the event time. A bucket's rows of one micro-batch are held together, so a source that may bring
    many at once should bound its micro-batches (``maxBytesPerTrigger``). A checkpoint belongs to its number of buckets.
    """
    use_state_store(stream.sparkSession)
    names = [MS, *[c for c in dict.fromkeys([*order, *columns]) if c not in keys]]
    own = [stream.schema[k] for k in keys]
    rows = T.StructType([*own, *[stream.schema[c] for c in names]])
    out = T.StructType([*rows, *T.StructType.fromDDL(outputs)])
    processor = OrderedScan(keys, order, rows, T.StructType([*own, *T.StructType.fromDDL(settled)]), scan)
    dealt = bucketed(stream, keys, buckets).select("_bucket", *keys, *names, "event_at")
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, out, "Append", "EventTime")


def _sums(values: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Running sums within each part."""
    return pd.Series(values).groupby(part).cumsum().to_numpy()


def _before(start: np.ndarray, after: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The value before each row: the one after the row above it, or the start of its part."""
    first = np.diff(part, prepend=-1) != 0
    return np.where(first, start[part], np.roll(after, 1))


@dataclass
class Moments:
    """Each value against mean and deviation of the values before it: n, mean and the sum of squares live in the state."""

    value: str
    min_n: int = 20
    empty = (0, 0.0, 0.0)

    def __call__(self, part: np.ndarray, settled: list[np.ndarray], rows: pd.DataFrame) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        n, mean, m2 = settled
        v = rows[self.value].to_numpy(np.float64)
        known = ~np.isnan(v)
        # Sums about a centre near the values; with a settled mean the shift costs no precision.
        first = pd.Series(v).groupby(part).first().fillna(0.0).to_numpy()
        centre = np.where(n > 0, mean, first)[part]
        d = np.where(known, v - centre, 0.0)
        count, total, square = n[part] + _sums(known.astype(np.int64), part), _sums(d, part), _sums(d * d, part)
        some = np.maximum(count, 1)
        after = [count, centre + total / some, m2[part] + np.maximum(square - total * total / some, 0.0)]
        before = [_before(start, column, part) for start, column in zip(settled, after, strict=True)]
        with np.errstate(divide="ignore", invalid="ignore"):
            std = np.sqrt(before[2] / before[0])
            z = np.where((before[0] >= self.min_n) & (std > 1e-6), (v - before[1]) / std, np.nan)
        return {"baseline_n": before[0].astype(np.int64), "z": z}, after


@dataclass
class Drawdown:
    """Value, high-water mark and drawdown of an account after each event: the total and the mark live in the state."""

    signed: str
    start: float = 100000.0
    empty = (0.0, -np.inf)

    def __call__(self, part: np.ndarray, settled: list[np.ndarray], rows: pd.DataFrame) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
        total, high = settled
        totals = total[part] + _sums(np.nan_to_num(rows[self.signed].to_numpy(np.float64)), part)
        value = np.round(totals + self.start, 2)
        highs = np.maximum(pd.Series(value).groupby(part).cummax().to_numpy(), high[part])
        return {"portfolio_value": value, "high": highs, "drawdown_pct": (highs - value) / highs * 100}, [totals, highs]


def baseline(stream: DataFrame, keys: list[str], time: str, value: str, min_n: int = 20, delay: str = "2 days") -> DataFrame:
    """Updates of ``keys``, ``value``, ``baseline_n`` and ``z``: running moments per series, each value scored before it counts.

    A null value is scored null and does not count; values of one time are taken in ascending order.
    """
    return ordered_scan(timed(stream, time, delay), keys, [value], [value], "n LONG, mean DOUBLE, m2 DOUBLE", "baseline_n LONG, z DOUBLE", Moments(value, min_n)).withColumn(
        "z", F.when(~F.isnan("z"), F.col("z"))
    )


def drawdown(stream: DataFrame, key: str, time: str, tie: str, signed: str, start: float = 100000.0, delay: str = "2 days") -> DataFrame:
    """Updates of ``key``, ``tie``, ``portfolio_value``, ``high``, ``drawdown_pct`` and ``level``, one per event, alerts at the limits."""
    scanned = ordered_scan(timed(stream, time, delay), [key], [tie], [tie, signed], "total DOUBLE, high DOUBLE", "portfolio_value DOUBLE, high DOUBLE, drawdown_pct DOUBLE", Drawdown(signed, start))
    drop = F.col("drawdown_pct")
    level = F.when(drop >= LIMITS["drawdown"], "breach").when(drop >= LIMITS["drawdown_alert"], "alert").otherwise("")
    return scanned.withColumn("level", level)


#: What a session counts besides its rows: the severities of a run log, and whether a run-end entry was met.
SEVERITIES = ("INFO", "WARN", "ERROR")
SESSION = T.StructType([*[T.StructField(c, T.LongType()) for c in ("start", "last", "events", "info", "warn", "error")], T.StructField("ended", T.BooleanType())])


@dataclass
class LogSessions(StatefulProcessor):
    """Open sessions of a run. A late row may start, lengthen or join sessions; a timer closes one when no row can reach it.

    Where ``shared``, a state is a bucket's, its rows hold ``run``, and its only timer is that of the session due first.
    """

    run: str
    gap_ms: int
    shared: T.DataType | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [*([self.run] if self.shared else []), *SESSION.names]
        self.open = handle.getListState("open", T.StructType([T.StructField(self.run, self.shared), *SESSION]) if self.shared else SESSION)

    def _timers(self, sessions: pd.DataFrame) -> set[int]:
        due = {last + self.gap_ms for last in sessions["last"].tolist()}
        return {min(due)} if self.shared and due else due

    def _rows(self, key, sessions: pd.DataFrame, status: str) -> pd.DataFrame:
        named = sessions if self.shared else sessions.assign(**{self.run: key[0]})
        return named[[self.run, *SESSION.names]].assign(status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = pd.DataFrame(_held(self.open), columns=self.names)
        new = pd.concat(list(rows), ignore_index=True)
        single = new[self.names[:-len(SESSION)]].assign(start=new[MS], last=new[MS], events=1)
        single = single.assign(**{s.lower(): (new["severity"] == s).astype("int64") for s in SEVERITIES}, ended=(new["phase"] == "run-end").astype(bool))
        every = pd.concat([*([before.assign(old=True)] if len(before) else []), single.assign(old=False)], ignore_index=True)
        every = every.assign(_run=every.groupby(self.run, dropna=False, sort=False).ngroup() if self.shared else 0)
        every = every.sort_values(["_run", "start", "last"], ignore_index=True)
        at, start, old = every["_run"].to_numpy(), every["start"].to_numpy(), every["old"].to_numpy(bool)
        # A session goes on while a row starts within the gap after all that its run has reached so far.
        reach = every.groupby("_run")["last"].cummax().to_numpy()
        begins = np.append(True, (at[1:] != at[:-1]) | (start[1:] - reach[:-1] >= self.gap_ms))
        session = np.cumsum(begins) - 1
        grouped = every.groupby(session)
        sums = grouped[["events", "info", "warn", "error"]].sum()
        joined = every.loc[begins, [*self.names[:-len(SESSION)], "start"]].reset_index(drop=True)
        joined = joined.assign(last=grouped["last"].max(), **{c: sums[c] for c in sums}, ended=grouped["ended"].max().astype(bool))[self.names]
        self.open.put(_plain(joined))
        had, has = self._timers(before), self._timers(joined)
        for due in had - has:
            self.handle.deleteTimer(due)
        for due in has - had:
            self.handle.registerTimer(due)
        changed = joined[~((np.bincount(session) == 1) & old[begins])]
        # A session whose start is no longer one has become part of another.
        gone = every[old & (start != joined["start"].to_numpy()[session])]
        yield pd.concat([self._rows(key, changed, "open"), self._rows(key, gone, "joined")], ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.shared:
            # The timer of the first session stands for all that the watermark has passed.
            due = max(due, timerValues.getCurrentWatermarkInMs() - 1)
        held = pd.DataFrame(_held(self.open), columns=self.names)
        over = held["last"].to_numpy(np.int64) + self.gap_ms <= due
        done, rest = held[over], held[~over]
        if len(rest):
            self.open.put(_plain(rest))
            if self.shared:
                self.handle.registerTimer(min(self._timers(rest)))
        else:
            self.open.clear()
        if len(done):
            yield self._rows(key, done, "closed")


def log_sessions(stream: DataFrame, run: str, time: str, gap_hours: float, delay: str, buckets: int | None = BUCKETS) -> DataFrame:
    """Updates of the sessions of a run log: ``run, start, events, info, warn, error, incomplete, status``.

    A session is emitted ``open`` when it starts or changes, ``closed`` when the watermark passes its gap, and ``joined`` when a
    late row made it part of the session before it. Without a run-end entry it is incomplete. State holds open sessions only,
    those of a bucket of runs together; without ``buckets`` each run has a state and a timer per session.
    """
    use_state_store(stream.sparkSession)
    rows = timed(stream, time, delay).select(run, MS, "severity", "phase", "event_at")
    out = T.StructType([stream.schema[run], *SESSION, T.StructField("status", T.StringType())])
    groups = rows.groupBy(run) if buckets is None else bucketed(rows, [run], buckets).groupBy("_bucket")
    processor = LogSessions(run, int(gap_hours * 3_600_000), None if buckets is None else stream.schema[run].dataType)
    found = groups.transformWithStateInPandas(processor, out, "Append", "EventTime")
    start = F.timestamp_millis("start")
    return found.select(run, start.alias("start"), "events", "info", "warn", "error", (~F.col("ended")).alias("incomplete"), "status")
