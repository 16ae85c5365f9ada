"""Registered queries: series cards, trends, z-scores, anomalies, labels, composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import GROWTH_WEIGHTS, PLAUSIBLE_RANGES, THRESHOLDS
from tidemark.functions import labels as L
from tidemark.functions.thresholds import label_by_metric, threshold_label, threshold_sql
from tidemark.operators import align, signals as sg
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.panel_queries import _wide
from tidemark.plans.registry import query
from tidemark.session import materialise

BASELINE_UNTIL = "1999-12-31"
S = "entity_id, series_id"
SO = f"PARTITION BY {S} ORDER BY obs_date"

_CARD = """SELECT {k}, arg_max({v}, {t}) AS latest_value, max({t}) AS latest_date, arg_max({v}, {t}) FILTER ({t} < last)
    AS prior_value, max({t}) FILTER ({t} < last) AS prior_date, arg_max({v}, {t}) FILTER ({t} <= last - 365) AS year_ago,
    avg(CASE WHEN {v} < latest THEN 100.0::DOUBLE ELSE 0 END) AS below, count(*) AS n FROM (SELECT *, max({t}) OVER
    (PARTITION BY {k}) AS last, last_value({v}) OVER (PARTITION BY {k} ORDER BY {t} ROWS BETWEEN UNBOUNDED PRECEDING AND
    UNBOUNDED FOLLOWING) AS latest FROM {src}) GROUP BY {k}"""
cte("cards", _CARD.format(k=S, v="value", t="obs_date", src="obs"), "obs")


def pct(num: str, base: str) -> str:
    return f"CASE WHEN {base} <> 0 THEN ({num}) / abs({base}) * 100 END"


@query(
    "series_cards",
    "WIN-10",
    compose(
        f"""SELECT {S}, latest_value, CAST(latest_date AS VARCHAR) AS latest_date, prior_value,
        CAST(prior_date AS VARCHAR) AS prior_date, latest_value - prior_value AS change_abs,
        {pct('latest_value - prior_value', 'prior_value')} AS change_pct, {pct('latest_value - year_ago', 'year_ago')}
        AS yoy_pct, CASE WHEN n >= 10 THEN below END AS percentile, n FROM cards""",
        "cards",
    ),
    "latest_value prior_value change_abs change_pct yoy_pct percentile",
)
def series_cards(spark, sf):
    return sg.latest_and_prior(b.observations(spark, sf))


@query(
    "positional_changes",
    "WIN-11",
    compose(
        f"""SELECT asset_id, CAST(max(price_date) AS VARCHAR) AS latest_date, max(close) FILTER (pos = 1) AS latest_value,
        {', '.join(f"(max(close) FILTER (pos = 1) - max(close) FILTER (pos = least({k} + 1, n))) / abs(max(close) FILTER (pos = least({k} + 1, n))) * 100 AS change_{k}_pct" for k in (5, 21, 65))}
        FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY price_date DESC) AS pos, count(*) OVER
        (PARTITION BY asset_id) AS n FROM prices) GROUP BY 1""",
        "prices",
    ),
    "latest_value change_5_pct change_21_pct change_65_pct",
)
def positional_changes(spark, sf):
    return sg.positional_change(b.prices(spark, sf), ["asset_id"], "price_date", "close")


@query(
    "latest_percentile_le",
    "WIN-12 SC-10",
    compose(
        f"""SELECT *, CASE WHEN percentile > 90 THEN 'overheating' WHEN percentile > 70 THEN 'hot' WHEN percentile > 30 THEN
        'moderate' WHEN percentile > 10 THEN 'cooling' WHEN percentile IS NOT NULL THEN 'declining' END AS heat FROM (SELECT {S},
        max(latest) AS latest_value, CASE WHEN count(*) >= 4 THEN avg(CASE WHEN value <= latest THEN 100.0::DOUBLE ELSE 0 END) END
        AS percentile FROM (SELECT *, first_value(value) OVER (PARTITION BY {S} ORDER BY obs_date DESC) AS latest FROM obs)
        GROUP BY 1, 2)""",
        "obs",
    ),
    "latest_value percentile",
)
def latest_percentile_le(spark, sf):
    ranked = sg.percentile_of_latest(b.observations(spark, sf), mode="le", min_n=4)
    return ranked.select("*", L.percentile_label(F.col("percentile")).alias("heat"))


_MOM = """SELECT entity_id, series_id, count(value) AS n, avg(value) AS mean, var_pop(value) * count(value) AS m2
    FROM obs WHERE obs_date {op} DATE '1999-12-31' GROUP BY 1, 2"""
cte("base", _MOM.format(op="<="), "obs")
cte("allmoments", "SELECT entity_id, series_id, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM obs GROUP BY 1, 2", "obs")


@query(
    "welford_merge",
    "AGG-22",
    compose(f"SELECT {S}, n, mean, std FROM allmoments", "allmoments"),
    "mean std",
)
def welford_merge(spark, sf):
    obs = materialise(b.observations(spark, sf), "observations")
    state = sg.moments(obs.where(F.col("obs_date") <= BASELINE_UNTIL))
    batch = sg.moments(obs.where(F.col("obs_date") > BASELINE_UNTIL))
    merged = sg.merge_moments(state, batch)
    return merged.select("entity_id", "series_id", "n", "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"))


cte(
    "zscores",
    f"""SELECT *, concat_ws('+', CASE WHEN abs(level_z) >= 2 THEN 'level' END, CASE WHEN abs(long_term_z) >= 2 THEN
    'long_term' END, CASE WHEN abs(roc_z) >= 2 THEN 'rate_of_change' END) AS flag_reason, CASE WHEN latest_value > mean
    THEN 'above_mean' ELSE 'below_mean' END AS direction, CASE WHEN roc_z > 0 THEN 'accelerating' WHEN roc_z IS NOT NULL
    THEN 'decelerating' END AS roc_direction, greatest(abs(level_z), abs(long_term_z), abs(roc_z)) AS max_z FROM (
    SELECT {S}, latest_value, c.mean AS mean, c.std AS std, coalesce(b.n, 0) AS baseline_n,
    (latest_value - c.mean) / c.std AS level_z, CASE WHEN b.n >= 20 AND sqrt(b.m2 / b.n) > 1e-6 THEN
    (latest_value - b.mean) / sqrt(b.m2 / b.n) END AS long_term_z, CASE WHEN c.n >= 11 AND dn >= 3 AND ds > 1e-6 THEN
    (d - dm) / ds END AS roc_z FROM (SELECT {S}, arg_max(value, obs_date) AS latest_value, avg(value) AS mean,
    stddev_pop(value) AS std, count(*) AS n, last(d ORDER BY obs_date) AS d, avg(d) AS dm, stddev_pop(d) AS ds, count(d) AS dn
    FROM (SELECT *, value - lag(value, 8) OVER ({SO}) AS d FROM obs) GROUP BY 1, 2) c LEFT JOIN base b USING ({S})
    WHERE c.n >= 10 AND c.std >= 1e-6)""",
    "obs",
    "base",
)


def scored(spark, sf):
    obs = materialise(b.observations(spark, sf), "observations")
    return sg.z_scores(obs, sg.moments(obs.where(F.col("obs_date") <= BASELINE_UNTIL)))


_Z = "latest_value mean std level_z long_term_z roc_z max_z"


@query("z_scores", "WIN-13", compose("SELECT * FROM zscores", "zscores"), _Z)
def z_scores(spark, sf):
    return scored(spark, sf)


@query("top_tensions", "TOP-2", compose("SELECT * FROM zscores WHERE flag_reason <> ''", "zscores"), _Z)
def top_tensions(spark, sf):
    return sg.tensions(scored(spark, sf))


cte(
    "trend_rows",
    f"""SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY obs_date DESC) AS pos, count(*) OVER (PARTITION BY {S}) AS n,
    value - lag(value) OVER ({SO}) AS d FROM obs""",
    "obs",
)
cte(
    "trends",
    f"""SELECT *, CASE WHEN base <> 0 THEN abs(cumulative / base * 100) ELSE 0 END AS cumulative_pct FROM (SELECT {S},
    w AS "window", count(*) FILTER (pos <= w AND d > 0) AS up, count(*) FILTER (pos <= w AND d < 0) AS down,
    count(*) FILTER (pos <= w AND d = 0) AS flat, max(value) FILTER (pos = 1) - max(value) FILTER (pos = w + 1) AS cumulative,
    max(value) FILTER (pos = w + 1) AS base, min(obs_date) AS start_date, max(obs_date) AS end_date
    FROM trend_rows, (VALUES (4), (8)) x(w) WHERE n >= 9 AND pos <= w + 1 GROUP BY 1, 2, 3)""",
    "trend_rows",
)


@query(
    "rolling_trends",
    "WIN-14",
    compose(
        f"""SELECT {S}, CAST("window" AS BIGINT) AS "window", up, down, flat, cumulative, cumulative_pct, CASE WHEN
        cumulative_pct < 0.05 THEN 'neutral' WHEN up >= "window" * 0.75 THEN 'expansion_bias' WHEN down >= "window" * 0.75
        THEN 'contraction_bias' WHEN up > down THEN 'mixed_positive' WHEN down > up THEN 'mixed_negative' ELSE 'neutral' END
        AS direction, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date FROM trends""",
        "trends",
    ),
    "cumulative cumulative_pct",
)
def rolling_trends(spark, sf):
    return sg.rolling_trend(b.observations(spark, sf))


def _weekly(spark, sf):
    return align.resample_last(b.prices(spark, sf), ["asset_id"], "week", "price_date", "close", "week")


cte(
    "weekly",
    """SELECT asset_id, week, arg_max(close, price_date) AS close FROM (SELECT *, CAST(price_date +
    CAST((12 - isodow(price_date)) % 7 AS INTEGER) AS DATE) AS week FROM prices) GROUP BY 1, 2""",
    "prices",
)


@query(
    "ma_momentum",
    "WIN-15",
    compose(
        """SELECT asset_id, close, fast_mean, slow_mean, CASE WHEN close > fast_mean AND close > slow_mean THEN
        'strong_uptrend' WHEN close > slow_mean THEN 'weakening' WHEN close > fast_mean THEN 'recovering' ELSE 'downtrend' END
        AS momentum, (close - slow_mean) / slow_mean * 100 AS pct_above_slow FROM (SELECT *, avg(close) OVER (PARTITION BY
        asset_id ORDER BY week ROWS 12 PRECEDING) AS fast_mean, avg(close) OVER (PARTITION BY asset_id ORDER BY week ROWS
        25 PRECEDING) AS slow_mean, count(*) OVER (PARTITION BY asset_id) AS n, row_number() OVER (PARTITION BY asset_id
        ORDER BY week DESC) AS pos FROM weekly) WHERE pos = 1 AND n >= 26""",
        "weekly",
    ),
    "close fast_mean slow_mean pct_above_slow",
)
def ma_momentum(spark, sf):
    return sg.ma_momentum(_weekly(spark, sf), ["asset_id"], "week", "close")


cte(
    "pairs",
    """SELECT entity_id, obs_date, a.value AS a_value, z.value AS b_value, a.value - z.value AS spread FROM
    (SELECT * FROM obs WHERE series_id = 'CPIAUCSL') a JOIN (SELECT * FROM obs WHERE series_id = 'CPILFESL') z
    USING (entity_id, obs_date)""",
    "obs",
)


def _pairs(spark, sf):
    obs = b.observations(spark, sf)
    a, z = (obs.where(F.col("series_id") == s) for s in ("CPIAUCSL", "CPILFESL"))
    return align.pair_spread(a, z, ["entity_id", "obs_date"])


@query(
    "pair_spread",
    "JN-5",
    compose("SELECT entity_id, CAST(obs_date AS VARCHAR) AS obs_date, a_value, b_value, spread FROM pairs", "pairs"),
    "a_value b_value spread",
)
def pair_spread(spark, sf):
    return _pairs(spark, sf)


@query(
    "spread_trend",
    "WIN-16",
    compose(
        """SELECT entity_id, n, early, late, CASE WHEN n >= 10 THEN CASE WHEN late > early + 0.5 THEN 'narrowing_to_wti_premium' WHEN
        late < early - 0.5 THEN 'widening_brent_premium' ELSE 'stable' END END AS trend FROM (SELECT entity_id, n, avg(spread) FILTER
        (pos > n - 5) AS early, avg(spread) FILTER (pos <= 5) AS late FROM (SELECT *, count(*) OVER (PARTITION BY entity_id)
        AS n FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY obs_date DESC) AS pos FROM pairs)
        WHERE pos <= 30) GROUP BY 1, 2)""",
        "pairs",
    ),
    "early late",
)
def spread_trend(spark, sf):
    return sg.spread_trend(_pairs(spark, sf), ["entity_id"], "obs_date")


_RANGES = ", ".join(f"('{s}', {lo}, {hi})" for s, (lo, hi) in PLAUSIBLE_RANGES.items())
cte(
    "anomalies",
    f"""SELECT {S}, latest_value, latest_date, lo::DOUBLE AS lo, hi::DOUBLE AS hi, CASE WHEN latest_value < lo * 0.5 OR
    latest_value > hi * 2 THEN 'high' ELSE 'medium' END AS severity FROM cards JOIN (VALUES {_RANGES}) r(series_id, lo, hi)
    USING (series_id) WHERE latest_value < lo OR latest_value > hi""",
    "cards",
)


def _cards(spark, sf):
    return sg.latest_and_prior(b.observations(spark, sf)).select("entity_id", "series_id", "latest_value", "latest_date")


@query(
    "range_anomalies",
    "FLT-3",
    compose(
        f"SELECT {S}, latest_value, CAST(latest_date AS VARCHAR) AS latest_date, lo, hi, severity FROM anomalies", "anomalies"
    ),
    "latest_value lo hi",
)
def range_anomalies(spark, sf):
    return sg.range_anomalies(_cards(spark, sf))


@query(
    "series_history",
    "SNK-2 TOP-5",
    compose(
        f"""SELECT {S}, count(*) AS points, CAST(min(obs_date) AS VARCHAR) AS first_date, first(value ORDER BY obs_date)
        AS first_value, last(value ORDER BY obs_date) AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY {S}
        ORDER BY obs_date DESC) AS pos FROM obs) WHERE pos <= 52 GROUP BY 1, 2""",
        "obs",
    ),
    "first_value last_value",
)
def series_history(spark, sf):
    nested = sg.nest_cards(b.observations(spark, sf))
    h = F.col("history")
    return nested.select(
        "entity_id",
        "series_id",
        F.size(h).alias("points"),
        h[0]["date"].alias("first_date"),
        h[0]["value"].alias("first_value"),
        F.element_at(h, -1)["value"].alias("last_value"),
    )


@query(
    "history_tail",
    "TOP-5",
    compose(
        f"""SELECT {S}, CAST(month AS VARCHAR) AS month, value FROM monthly QUALIFY row_number() OVER (PARTITION BY {S}
        ORDER BY month DESC) <= 26""",
        "monthly",
    ),
    "value",
)
def history_tail(spark, sf):
    return sg.tail(align.resample_last(b.observations(spark, sf)), 26, time="month")


cte(
    "net_positions",
    """SELECT p_brand AS contract, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(CASE WHEN l_linestatus = 'F'
    THEN l_quantity ELSE 0 END) AS long_qty, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS short_qty
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
cte("net_src", "SELECT contract, week AS obs_date, long_qty - short_qty AS value FROM net_positions", "net_positions")
cte("net_cards", _CARD.format(k="contract", v="value", t="obs_date", src="net_src"), "net_src")


@query(
    "positioning",
    "SC-9 SRC-7",
    compose(
        """SELECT contract, latest_value AS net, latest_value - prior_value AS change, p AS percentile, CASE WHEN p >= 90 THEN
        'extreme long' WHEN p <= 10 THEN 'extreme short' WHEN p >= 80 THEN 'crowded long' WHEN p <= 20 THEN 'crowded short'
        END AS crowding, CASE WHEN prior_value IS NOT NULL THEN CASE WHEN latest_value > 0 AND latest_value > prior_value
        THEN 'building long' WHEN latest_value > 0 AND latest_value < prior_value THEN 'unwinding long' WHEN latest_value < 0
        AND latest_value < prior_value THEN 'building short' WHEN latest_value < 0 AND latest_value > prior_value THEN
        'unwinding short' ELSE 'flat' END END AS direction FROM (SELECT *, CASE WHEN n >= 10 THEN below END AS p
        FROM net_cards)""",
        "net_cards",
    ),
    "net change percentile",
)
def positioning(spark, sf):
    return sg.positioning(b.net_positions(spark, sf), "contract", "week", "net")


_METRIC_SQL = " UNION ALL ".join(
    f"SELECT indicator, '{m}' AS metric, {threshold_sql('value', m)} AS label FROM indicators WHERE value IS NOT NULL"
    for m in THRESHOLDS
)


@query(
    "threshold_labels",
    "SC-6 SC-15",
    compose(f"SELECT indicator, metric, label, count(*) AS n FROM ({_METRIC_SQL}) GROUP BY 1, 2, 3", "indicators"),
)
def threshold_labels(spark, sf):
    values = align.to_indicators(align.resample_last(b.observations(spark, sf))).where(F.col("value").isNotNull())
    spread = values.select("indicator", "value", F.explode(F.array(*[F.lit(m) for m in THRESHOLDS])).alias("metric"))
    labelled = spread.select("indicator", "metric", label_by_metric(F.col("metric"), F.col("value")).alias("label"))
    return labelled.groupBy("indicator", "metric", "label").agg(F.count("*").alias("n"))


cte(
    "moves",
    """SELECT *, 100 + indpro_yoy AS level, indpro_yoy - lag(indpro_yoy) OVER e AS change, m2_yoy - lag(m2_yoy) OVER e AS dm2,
    fed_assets_yoy - lag(fed_assets_yoy) OVER e AS dfed FROM wide WINDOW e AS (PARTITION BY entity_id ORDER BY month)""",
    "wide",
)


def _moves(spark, sf):
    d = lambda c: align.diff(F.col(c), 1, ["entity_id"], "month")
    return _wide(spark, sf).select(
        "*",
        (F.col("indpro_yoy") + 100).alias("level"),
        d("indpro_yoy").alias("change"),
        d("m2_yoy").alias("dm2"),
        d("fed_assets_yoy").alias("dfed"),
    )


_TWO_AXIS = """CASE WHEN level >= 100 AND change > 0 THEN 'expanding' WHEN level >= 100 THEN 'decelerating' WHEN change > 0
    THEN 'recovering' WHEN level IS NOT NULL AND change IS NOT NULL THEN 'contracting' END"""


@query(
    "axis_and_flow_labels",
    "SC-7 SC-8 SC-11",
    compose(
        f"""SELECT entity_id, CAST(month AS VARCHAR) AS month, {_TWO_AXIS} AS cycle, CASE WHEN dm2 IS NULL OR dfed IS NULL
        THEN 'neutral' WHEN dm2 < 0 AND dfed < 0 THEN 'double injection' WHEN dm2 < 0 OR dfed < 0 THEN 'net injection'
        WHEN dm2 > 0 AND dfed > 0 THEN 'double drain' ELSE 'net drain' END AS flow, CASE WHEN change > 0 THEN 'rising'
        WHEN change < 0 THEN 'falling' WHEN change IS NOT NULL THEN 'stable' END AS move FROM moves""",
        "moves",
    ),
)
def axis_and_flow_labels(spark, sf):
    return _moves(spark, sf).select(
        "entity_id",
        "month",
        L.two_axis_label(F.col("level"), F.col("change")).alias("cycle"),
        L.flow_label(F.col("dm2"), F.col("dfed")).alias("flow"),
        L.change_direction(F.col("change"), "rising", "falling").alias("move"),
    )


@query(
    "derived_rates",
    "SC-12",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, cpi_yoy - core_cpi_yoy AS real_rate, (m2_yoy - fed_assets_yoy)
        * 100 AS spread_bps, CASE WHEN unrate > 0 THEN nfci / unrate END AS days_of_supply, indpro_yoy / 1000 AS scaled
        FROM wide""",
        "wide",
    ),
    "real_rate spread_bps days_of_supply scaled",
)
def derived_rates(spark, sf):
    return _wide(spark, sf).select(
        "entity_id",
        "month",
        (F.col("cpi_yoy") - F.col("core_cpi_yoy")).alias("real_rate"),
        ((F.col("m2_yoy") - F.col("fed_assets_yoy")) * 100).alias("spread_bps"),
        F.when(F.col("unrate") > 0, F.col("nfci") / F.col("unrate")).alias("days_of_supply"),
        (F.col("indpro_yoy") / 1000).alias("scaled"),
    )


@query(
    "diffusion_composite",
    "AGG-35",
    compose(
        """SELECT *, CASE WHEN expanding > contracting THEN 'expansion' WHEN contracting > expanding THEN 'contraction'
        ELSE 'mixed' END AS consensus, CASE WHEN abs(average) < 2 THEN 'marginal' WHEN abs(average) < 10 THEN 'moderate'
        ELSE 'strong' END AS conviction FROM (SELECT entity_id, CAST(month AS VARCHAR) AS month, count(*) FILTER (value > 0)
        AS expanding, count(*) FILTER (value < 0) AS contracting, count(*) AS total, avg(value) AS average FROM indicators
        WHERE indicator IN ('indpro_yoy', 'retail_yoy', 'payrolls_yoy') AND value IS NOT NULL GROUP BY 1, 2)""",
        "indicators",
    ),
    "average",
)
def diffusion_composite(spark, sf):
    values = align.to_indicators(align.resample_last(b.observations(spark, sf)))
    surveys = values.where(F.col("indicator").isin("indpro_yoy", "retail_yoy", "payrolls_yoy"))
    return sg.diffusion_composite(surveys, ["entity_id", "month"])


_PROXY_MAP = {
    "indpro_yoy": "lending_survey",
    "m2_yoy": "business_loans_yoy",
    "retail_yoy": "loan_fund_month_change",
    "fed_assets_yoy": "lender_fund_month_change",
    "unrate": "hy_spread",
}
_PROXY_SQL = " UNION ALL ".join(
    f"""SELECT entity_id, month, {s} AS s, {e} AS e FROM (SELECT entity_id, month, value,
    {threshold_sql('value', m)} AS l FROM indicators WHERE indicator = '{i}' AND value IS NOT NULL)"""
    for i, m, s, e in [
        ("indpro_yoy", "lending_survey", "l IN ('tightening', 'severe tightening')", "l IN ('easing', 'strong easing')"),
        ("m2_yoy", "business_loans_yoy", "l = 'contracting'", "l IN ('moderate growth', 'rapid growth')"),
        ("retail_yoy", "loan_fund_month_change", "l = 'stress'", "l IN ('firming', 'risk-on')"),
        ("fed_assets_yoy", "lender_fund_month_change", "l = 'stress'", "l IN ('firming', 'risk-on')"),
        ("unrate", "hy_spread", "value > 5.0", "value < 3.5"),
    ]
)


@query(
    "proxy_convergence",
    "AGG-36",
    compose(
        f"""SELECT entity_id, CAST(month AS VARCHAR) AS month, stress, easing, total - stress - easing AS neutral, total, CASE
        WHEN stress >= 2 AND stress > easing THEN 'stress — majority of proxies converging' WHEN easing >= 2 AND easing > stress THEN 'benign — majority of proxies converging' WHEN total <= 1
        THEN 'insufficient data — need at least 2 proxies for directional call' WHEN stress > 0 AND stress = easing THEN 'inconclusive — proxies actively diverging (stress and easing signals present)' ELSE 'inconclusive — no clear signal' END
        AS composite FROM (SELECT entity_id, month, count(*) FILTER (s) AS stress, count(*) FILTER (e) AS easing, count(*)
        AS total FROM ({_PROXY_SQL}) GROUP BY 1, 2)""",
        "indicators",
    ),
)
def proxy_convergence(spark, sf):
    values = align.to_indicators(align.resample_last(b.observations(spark, sf)))
    names = F.create_map(*[F.lit(x) for item in _PROXY_MAP.items() for x in item])
    proxies = values.where(F.col("indicator").isin(list(_PROXY_MAP))).select(
        "entity_id", "month", names[F.col("indicator")].alias("metric"), "value"
    )
    return sg.proxy_convergence(proxies, ["entity_id", "month"])


@query(
    "cross_entity_divergence",
    "AGG-37",
    compose(
        f"""SELECT CAST(month AS VARCHAR) AS month, decelerating, home_label, CASE WHEN up AND slow_away >= away / 2.0 THEN
        'diverging_up' WHEN NOT up AND NOT slow_away >= away / 2.0 THEN 'diverging_down' ELSE 'aligned' END AS home_vs_world,
        decelerating >= 3 AS simultaneous FROM (SELECT *, coalesce(home_label IN ('expanding', 'recovering'), false) AS up
        FROM (SELECT month, count(*) FILTER (label IN ('decelerating', 'contracting')) AS decelerating,
        count(*) FILTER (label IN ('decelerating', 'contracting') AND entity_id <> '0') AS slow_away,
        count(*) FILTER (entity_id <> '0') AS away, max(label) FILTER (entity_id = '0') AS home_label FROM (SELECT entity_id,
        month, {_TWO_AXIS} AS label FROM moves) WHERE label IS NOT NULL GROUP BY 1))""",
        "moves",
    ),
)
def cross_entity_divergence(spark, sf):
    labelled = _moves(spark, sf).select(
        "entity_id", "month", L.two_axis_label(F.col("level"), F.col("change")).alias("label")
    )
    return sg.cross_entity_divergence(labelled, "month", "0")


@query(
    "group_gap",
    "AGG-38",
    compose(
        """SELECT CAST(month AS VARCHAR) AS month, a_value, b_value, coalesce(abs(a_value - b_value) > 3, false) AS diverging
        FROM (SELECT month, avg(m2_yoy) FILTER (CAST(entity_id AS INT) % 5 = 0) AS a_value, avg(m2_yoy) FILTER
        (CAST(entity_id AS INT) % 5 = 1) AS b_value FROM wide GROUP BY 1)""",
        "wide",
    ),
    "a_value b_value",
)
def group_gap(spark, sf):
    grouped = _wide(spark, sf).select("month", "m2_yoy", (F.col("entity_id").cast("int") % 5).cast("string").alias("bloc"))
    return sg.group_gap(grouped, ["month"], "bloc", "m2_yoy", "0", "1")


@query(
    "systemic_overheating",
    "AGG-38 SC-10",
    compose(
        f"""SELECT series_id, count(*) FILTER (p > 90) AS overheating, count(*) FILTER (p > 90) >= 3 AS systemic FROM (
        SELECT {S}, avg(CASE WHEN value <= latest THEN 100.0::DOUBLE ELSE 0 END) AS p FROM (SELECT *, first_value(value) OVER
        (PARTITION BY {S} ORDER BY month DESC) AS latest FROM monthly) GROUP BY 1, 2) GROUP BY 1""",
        "monthly",
    ),
)
def systemic_overheating(spark, sf):
    ranked = sg.percentile_of_latest(align.resample_last(b.observations(spark, sf)), time="month", mode="le", min_n=4)
    heat = ranked.select("series_id", L.percentile_label(F.col("percentile")).alias("heat"))
    return sg.systemic(heat, ["series_id"])


_FIELDS = ("UNRATE", "PAYEMS", "M2SL")


@query(
    "latest_per_field",
    "AGG-39",
    compose(
        "SELECT entity_id, "
        + ", ".join(f"arg_max(value, yr) FILTER (series_id = '{f}' AND value IS NOT NULL) AS {f.lower()}" for f in _FIELDS)
        + """ FROM (SELECT entity_id, series_id, year(month) AS yr, CASE WHEN count(*) = 12 THEN avg(value) END AS value
        FROM monthly GROUP BY 1, 2, 3) GROUP BY 1""",
        "monthly",
    ),
    "unrate payems m2sl",
)
def latest_per_field(spark, sf):
    monthly = align.resample_last(b.observations(spark, sf))
    yearly = monthly.groupBy("entity_id", "series_id", F.year("month").alias("yr")).agg(
        F.when(F.count("*") == 12, F.avg("value")).alias("value")
    )
    out = sg.latest_per_field(yearly, "entity_id", "series_id", "yr", "value", _FIELDS)
    return out.select("entity_id", *[F.col(f).alias(f.lower()) for f in _FIELDS])


@query(
    "surprises_vs_consensus",
    "SC-31",
    compose(
        f"""SELECT {S}, CAST(month AS VARCHAR) AS month, value, consensus, value - consensus AS surprise,
        sign(value - consensus)::DOUBLE AS sign, avg(sign(value - consensus)) OVER (PARTITION BY {S} ORDER BY month ROWS
        3 PRECEDING) AS trend FROM (SELECT *, CASE WHEN count(value) OVER q = 3 THEN avg(value) OVER q END AS consensus
        FROM monthly WINDOW q AS (PARTITION BY {S} ORDER BY month ROWS BETWEEN
        3 PRECEDING AND 1 PRECEDING))""",
        "monthly",
    ),
    "value consensus surprise sign trend",
)
def surprises_vs_consensus(spark, sf):
    from pyspark.sql import Window

    monthly = align.resample_last(b.observations(spark, sf))
    w = Window.partitionBy("entity_id", "series_id").orderBy("month").rowsBetween(-3, -1)
    known = monthly.select("*", F.when(F.count("value").over(w) == 3, F.avg("value").over(w)).alias("consensus"))
    return sg.surprise(known, ["entity_id", "series_id"], "month", "value", "consensus")


_WNAMES = {"indpro_yoy": "mfg", "unrate": "unemployment", "payrolls_yoy": "payrolls", "retail_yoy": "retail"}


@query(
    "weighted_growth_score",
    "SC-17",
    compose(
        "SELECT entity_id, CAST(month AS VARCHAR) AS month, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, sum(w * v) / sum(w))) AS score FROM ("
        + " UNION ALL ".join(
            f"SELECT entity_id, month, {c} AS v, {w}::DOUBLE AS w FROM votes"
            for c, w in [("v_indpro", 0.3), ("v_unrate", 0.2), ("v_payrolls", 0.2), ("v_retail", 0.15)]
        )
        + ") WHERE v IS NOT NULL GROUP BY 1, 2",
        "votes",
    ),
    "score",
)
def weighted_growth_score(spark, sf):
    from tidemark.operators import regime

    votes = _wide(spark, sf).select("entity_id", "month", *regime.growth_votes())
    pairs = ", ".join(f"'{short}', vote_{c}" for c, short in _WNAMES.items())
    long = votes.selectExpr("entity_id", "month", f"stack({len(_WNAMES)}, {pairs}) AS (indicator, value)")
    return sg.weighted_score(long, ["entity_id", "month"], GROWTH_WEIGHTS)


@query(
    "union_of_sources",
    "SET-1",
    compose(
        """SELECT source, count(*) AS n, count(DISTINCT key) AS n_keys, sum(value) / count(*) AS mean FROM (
        SELECT 'macro' AS source, entity_id || '/' || series_id AS key, value FROM obs UNION ALL SELECT 'market', asset_id, close
        FROM prices) GROUP BY 1""",
        "obs",
        "prices",
    ),
    "mean",
)
def union_of_sources(spark, sf):
    macro = b.observations(spark, sf).select(
        F.lit("macro").alias("source"), F.concat_ws("/", "entity_id", "series_id").alias("key"), "value"
    )
    market = b.prices(spark, sf).select(F.lit("market").alias("source"), F.col("asset_id").alias("key"), F.col("close").alias("value"))
    return macro.unionByName(market).groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), F.avg("value").alias("mean")
    )
