"""Registered queries: runs, transitions, durations, streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, labels as L
from tidemark.operators import transitions as tr
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.panel_queries import regimes
from tidemark.plans.registry import query
from tidemark.session import materialise

SINCE = "1999-01-01"
E_KEY = ["entity_id"]


def _values(labels) -> str:
    return ", ".join(f"('{x}')" for x in labels)


def _runs_cte(name: str, label: str) -> None:
    cte(
        name,
        f"""SELECT entity_id, run, {label} AS label, min(month) AS start, max(month) AS "end", count(*) AS length,
        run = max(run) OVER (PARTITION BY entity_id) AS is_current FROM (SELECT *, sum(c) OVER (PARTITION BY entity_id
        ORDER BY month ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN {label} IS DISTINCT FROM
        lag({label}) OVER (PARTITION BY entity_id ORDER BY month) THEN 1 ELSE 0 END AS c FROM regimes))
        GROUP BY entity_id, run, {label}""",
        "regimes",
    )


_runs_cte("runs4", "regime")
_runs_cte("runs8", "regime_8")


def _counts_cte(name: str, label: str, labels, source: str = "regimes", keys: str = "entity_id") -> None:
    cte(
        name,
        f"""SELECT *, CASE WHEN n_source > 0 THEN n / n_source END AS prob, n_source < 10 AS low_n FROM (SELECT *,
        CAST(sum(n) OVER (PARTITION BY {keys}, horizon, source) AS BIGINT) AS n_source FROM (
        SELECT g.*, (SELECT NULL) IS NULL AS x, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {keys}, horizon, s.l AS source,
        t.l AS target FROM {source}, (VALUES (6), (12)) h(horizon), (VALUES {_values(labels)}) s(l),
        (VALUES {_values(labels)}) t(l)) g LEFT JOIN (SELECT {keys}, horizon, source, target, count(*) AS n FROM (
        SELECT {keys}, 6 AS horizon, {label} AS source, lead({label}, 6) OVER (PARTITION BY {keys} ORDER BY month)
        AS target FROM {source} UNION ALL SELECT {keys}, 12, {label}, lead({label}, 12) OVER
        (PARTITION BY {keys} ORDER BY month) FROM {source}) WHERE target IS NOT NULL GROUP BY ALL) c
        USING ({keys}, horizon, source, target)))""",
        source,
    )


_counts_cte("counts4", "regime", L.FAMILIES)
_counts_cte("counts8", "regime_8", L.LABELS_8)
cte(
    "shrunk",
    """SELECT *, CASE WHEN tot > 0 THEN m / tot ELSE m END AS shrunk FROM (SELECT *, sum(m) OVER (PARTITION BY entity_id,
    horizon, source) AS tot FROM (SELECT e.*, CASE WHEN f.prob IS NULL THEN e.prob ELSE e.n_source / (e.n_source + 10.0) *
    e.prob + (1 - e.n_source / (e.n_source + 10.0)) * f.prob / 2 END AS m FROM counts8 e LEFT JOIN counts4 f
    ON e.entity_id = f.entity_id AND e.horizon = f.horizon AND string_split(e.source, ' — ')[1] = f.source
    AND string_split(e.target, ' — ')[1] = f.target))""",
    "counts8",
    "counts4",
)


def counts4(spark, sf, table=None):
    return tr.transition_counts(regimes(spark, sf) if table is None else table, E_KEY, "month", "regime", L.FAMILIES)


def shrunk(spark, sf, table=None):
    table = materialise(regimes(spark, sf), "regimes") if table is None else table
    eight = tr.transition_counts(table, E_KEY, "month", "regime_8", L.LABELS_8)
    four = tr.transition_counts(table, E_KEY, "month", "regime", L.FAMILIES)
    return tr.shrink(eight, four, E_KEY)


@query(
    "regime_runs",
    "WIN-7",
    compose(
        """SELECT entity_id, CAST(run AS BIGINT) AS run, label AS regime, CAST(start AS VARCHAR) AS start,
        CAST("end" AS VARCHAR) AS "end", length, is_current FROM runs4""",
        "runs4",
    ),
)
def regime_runs(spark, sf):
    return tr.runs(regimes(spark, sf), E_KEY, "month", "regime")


@query(
    "regime_timeline",
    "WIN-7",
    compose(
        """SELECT entity_id, label AS regime, CAST(start AS VARCHAR) AS start, CAST(coalesce(lead(start) OVER
        (PARTITION BY entity_id ORDER BY start), "end") AS VARCHAR) AS "end" FROM runs4""",
        "runs4",
    ),
)
def regime_timeline(spark, sf):
    return tr.timeline(regimes(spark, sf), E_KEY, "month", "regime")


@query(
    "transition_counts",
    "AGG-9",
    compose("SELECT entity_id, CAST(horizon AS BIGINT) AS horizon, source, target, n, n_source, prob, low_n FROM counts4", "counts4"),
    "prob",
)
def transition_counts(spark, sf):
    return counts4(spark, sf)


@query(
    "shrunk_transitions",
    "AGG-10",
    compose(
        "SELECT entity_id, CAST(horizon AS BIGINT) AS horizon, source, target, n, n_source, prob, shrunk FROM shrunk", "shrunk"
    ),
    "prob shrunk",
)
def shrunk_transitions(spark, sf):
    return shrunk(spark, sf)


@query(
    "regime_durations",
    "AGG-11",
    compose(
        """SELECT entity_id, label AS regime_8, avg(length) AS mean_months, CAST(trunc(quantile_cont(length, 0.5)) AS BIGINT)
        AS median_months, max(length) AS max_months, count(*) AS n_episodes,
        CAST(max(CASE WHEN is_current THEN length END) AS DOUBLE) AS current_months FROM runs8 GROUP BY 1, 2""",
        "runs8",
    ),
    "mean_months current_months",
)
def regime_durations(spark, sf):
    return tr.duration_stats(regimes(spark, sf), E_KEY, "month", "regime_8")


@query(
    "regime_frequency",
    "AGG-12",
    compose(
        """SELECT entity_id, regime_8, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY
        entity_id) AS pct FROM regimes GROUP BY 1, 2""",
        "regimes",
    ),
    "pct",
)
def regime_frequency(spark, sf):
    return tr.frequency(regimes(spark, sf), E_KEY, "regime_8")


cte(
    "sampled",
    f"""SELECT *, count(*) OVER (PARTITION BY entity_id, sample) AS n_rows FROM (SELECT *, 'full' AS sample FROM regimes
    UNION ALL SELECT *, 'recent' FROM regimes WHERE month >= DATE '{SINCE}')""",
    "regimes",
)
cte(
    "kept",
    """SELECT *, bool_or(regexp_matches(regime_8, '(Ample|Tight) Liquidity$')) OVER (PARTITION BY entity_id, sample) AS valid_8
    FROM sampled WHERE n_rows >= 12""",
    "sampled",
)
_counts_cte("kept4", "regime", L.FAMILIES, "kept", "entity_id, sample")


@query(
    "windowed_transitions",
    "AGG-13",
    compose(
        """SELECT entity_id, sample, valid_8, CAST(horizon AS BIGINT) AS horizon, source, target, n, n_source, prob, low_n
        FROM kept4 JOIN (SELECT DISTINCT entity_id, sample, valid_8 FROM kept) USING (entity_id, sample)""",
        "kept4",
        "kept",
    ),
    "prob",
)
def windowed_transitions(spark, sf):
    sampled = tr.sample_windows(regimes(spark, sf), E_KEY, "month", SINCE)
    return tr.transition_counts(sampled, ["entity_id", "sample", "valid_8"], "month", "regime", L.FAMILIES)


cte("kept_valid", "SELECT * FROM kept WHERE valid_8", "kept")
_counts_cte("kept8", "regime_8", L.LABELS_8, "kept_valid", "entity_id, sample")
_SAMPLE = ["entity_id", "sample"]


def _sampled(spark, sf):
    return materialise(tr.sample_windows(regimes(spark, sf), E_KEY, "month", SINCE), "samples")


@query(
    "windowed_shrunk",
    "AGG-13",
    compose(
        """SELECT entity_id, sample, CAST(horizon AS BIGINT) AS horizon, source, target, n, n_source, prob, CASE WHEN tot > 0 THEN m / tot ELSE m END AS shrunk
        FROM (SELECT *, sum(m) OVER (PARTITION BY entity_id, sample, horizon, source) AS tot FROM (SELECT e.*, CASE WHEN f.prob IS NULL THEN e.prob ELSE
        e.n_source / (e.n_source + 10.0) * e.prob + (1 - e.n_source / (e.n_source + 10.0)) * f.prob / 2 END AS m FROM kept8 e LEFT JOIN kept4 f
        ON e.entity_id = f.entity_id AND e.sample = f.sample AND e.horizon = f.horizon AND string_split(e.source, ' — ')[1] = f.source
        AND string_split(e.target, ' — ')[1] = f.target))""",
        "kept8",
        "kept4",
    ),
    "prob shrunk",
)
def windowed_shrunk(spark, sf):
    sampled = _sampled(spark, sf)
    eight = tr.transition_counts(sampled.where("valid_8"), _SAMPLE, "month", "regime_8", L.LABELS_8)
    return tr.shrink(eight, tr.transition_counts(sampled, _SAMPLE, "month", "regime", L.FAMILIES), _SAMPLE)


def _sample_runs(label: str, source: str, n: int) -> str:
    return f"""SELECT entity_id, sample, {n}::BIGINT AS label_set, label, avg(length) AS mean_months, CAST(trunc(quantile_cont(length, 0.5)) AS BIGINT) AS
    median_months, max(length) AS max_months, count(*) AS n_episodes, CAST(max(CASE WHEN run = last THEN length END) AS DOUBLE) AS current_months FROM (SELECT
    entity_id, sample, run, {label} AS label, count(*) AS length, max(run) OVER (PARTITION BY entity_id, sample) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY
    entity_id, sample ORDER BY month ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN {label} IS DISTINCT FROM lag({label}) OVER (PARTITION BY
    entity_id, sample ORDER BY month) THEN 1 ELSE 0 END AS c FROM {source})) GROUP BY entity_id, sample, run, {label}) GROUP BY ALL"""


@query(
    "windowed_durations",
    "AGG-13",
    compose(_sample_runs("regime", "kept", 4) + " UNION ALL " + _sample_runs("regime_8", "kept_valid", 8), "kept", "kept_valid"),
    "mean_months current_months",
)
def windowed_durations(spark, sf):
    return tr.by_label_set(_sampled(spark, sf), lambda rows, label: tr.duration_stats(rows, _SAMPLE, "month", label))


def _sample_share(label: str, source: str, n: int) -> str:
    return f"""SELECT entity_id, sample, {n}::BIGINT AS label_set, {label} AS label, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY
    entity_id, sample) AS pct FROM {source} GROUP BY entity_id, sample, {label}"""


@query(
    "windowed_frequency",
    "AGG-13",
    compose(_sample_share("regime", "kept", 4) + " UNION ALL " + _sample_share("regime_8", "kept_valid", 8), "kept", "kept_valid"),
    "pct",
)
def windowed_frequency(spark, sf):
    return tr.by_label_set(_sampled(spark, sf), lambda rows, label: tr.frequency(rows, _SAMPLE, label))


cte(
    "weekly_history",
    """SELECT account_id, week, week_no, event_type AS family, n_events, last_event, diverged, liquidity_diverged
    FROM (SELECT *, n_top * 2 < n_events AS diverged, value_sum < 200 AS liquidity_diverged FROM (SELECT account_id, week,
    week_no, CAST(sum(n) AS BIGINT) AS n_events, max(last_event) AS last_event, max(n) AS n_top,
    arg_max(event_type, (n, event_type)) AS event_type, round(sum(v), 2) AS value_sum FROM (SELECT
    CAST(user_id AS VARCHAR) AS account_id, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week,
    CAST(date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) // 7 AS BIGINT) AS week_no, event_type, count(*) AS n,
    max(event_id) AS last_event, sum(value) AS v FROM events GROUP BY ALL) GROUP BY account_id, week, week_no))""",
)


@query(
    "weekly_families",
    "TOP-7 SC-18",
    compose(
        "SELECT account_id, week, week_no, family, n_events, last_event, diverged, liquidity_diverged FROM weekly_history",
        "weekly_history",
    ),
)
def weekly_families(spark, sf):
    return b.weekly_history(spark, sf)


@query(
    "dedupe_latest",
    "TOP-7",
    """SELECT account_id, week, event_id, event_type FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, isoyear(ts) ||
    '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, event_id, event_type, ts FROM events)
    QUALIFY row_number() OVER (PARTITION BY account_id, week ORDER BY ts DESC, event_id DESC) = 1""",
)
def dedupe_latest(spark, sf):
    hist = b.events(spark, sf).select(
        "account_id", dates.iso_week(F.col("day")).alias("week"), "event_id", "event_type", F.struct("ts", "event_id").alias("at")
    )
    return tr.dedupe_latest(hist, ["account_id", "week"], "at").drop("at")


@query(
    "trailing_streaks",
    "WIN-8",
    compose(
        """SELECT account_id, CAST(coalesce(min(CASE WHEN NOT same THEN pos END), count(*) + 1) - 1 AS BIGINT) AS same_family,
        CAST(coalesce(min(CASE WHEN NOT diverged THEN pos END), count(*) + 1) - 1 AS BIGINT) AS diverged_weeks,
        CAST(coalesce(min(CASE WHEN NOT liquidity_diverged THEN pos END), count(*) + 1) - 1 AS BIGINT) AS liquidity_weeks
        FROM (SELECT *, family = first_value(family) OVER (PARTITION BY account_id ORDER BY week DESC) AS same,
        row_number() OVER (PARTITION BY account_id ORDER BY week DESC) AS pos FROM weekly_history) GROUP BY 1""",
        "weekly_history",
    ),
)
def trailing_streaks(spark, sf):
    hist = materialise(b.weekly_history(spark, sf), "weekly")
    now = hist.groupBy("account_id").agg(F.max_by("family", "week").alias("now"))
    return tr.trailing_streak(
        hist.join(now, "account_id"),
        ["account_id"],
        "week",
        {
            "same_family": F.col("family") == F.col("now"),
            "diverged_weeks": F.col("diverged"),
            "liquidity_weeks": F.col("liquidity_diverged"),
        },
    )
