"""Registered queries: alignment, scores, labels, confirmation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import dates, labels
from tidemark.operators import align, regime
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose
from tidemark.plans.registry import query

INDICATORS = [name for name, _, _ in align.INDICATORS.values()]


def _monthly(spark, sf):
    return align.resample_last(b.observations(spark, sf))


def _wide(spark, sf):
    return regime.aligned(b.observations(spark, sf))


def regimes(spark, sf):
    return regime.classify(b.observations(spark, sf))


@query(
    "resample_month_last",
    "AGG-1 SRC-1",
    compose("SELECT entity_id, series_id, CAST(month AS VARCHAR) AS month, value FROM monthly", "monthly"),
    "value",
)
def resample_month_last(spark, sf):
    return _monthly(spark, sf)


@query(
    "resample_week_last",
    "AGG-1",
    compose(
        """SELECT asset_id, CAST(week AS VARCHAR) AS week, arg_max(close, price_date) AS close FROM (SELECT *,
        CAST(price_date + CAST((12 - isodow(price_date)) % 7 AS INTEGER) AS DATE) AS week FROM prices) GROUP BY 1, 2""",
        "prices",
    ),
    "close",
)
def resample_week_last(spark, sf):
    return align.resample_last(b.prices(spark, sf), ["asset_id"], "week", "price_date", "close", "week")


@query(
    "indicator_changes",
    "WIN-1",
    compose("SELECT entity_id, CAST(month AS VARCHAR) AS month, indicator, value FROM indicators", "indicators"),
    "value",
)
def indicator_changes(spark, sf):
    return align.to_indicators(_monthly(spark, sf))


@query(
    "aligned_indicators",
    "JN-3",
    compose(f"SELECT entity_id, CAST(month AS VARCHAR) AS month, {', '.join(INDICATORS)} FROM wide", "wide"),
    " ".join(INDICATORS),
)
def aligned_indicators(spark, sf):
    return _wide(spark, sf)


@query(
    "direction_signals",
    "WIN-2",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, v_indpro AS vote_indpro_yoy, v_unrate AS vote_unrate,
        v_retail AS vote_retail_yoy, v_payrolls AS vote_payrolls_yoy FROM votes""",
        "votes",
    ),
    "vote_indpro_yoy vote_unrate vote_retail_yoy vote_payrolls_yoy",
)
def direction_signals(spark, sf):
    return _wide(spark, sf).select("entity_id", "month", *regime.growth_votes())


@query(
    "rolling_medians",
    "WIN-3",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, m_m2 AS median_m2_yoy, m_nfci AS median_nfci,
        m_fed AS median_fed_assets_yoy FROM votes""",
        "votes",
    ),
    "median_m2_yoy median_nfci median_fed_assets_yoy",
)
def rolling_medians(spark, sf):
    return _wide(spark, sf).select(
        "entity_id",
        "month",
        *[
            align.rolling_median(F.col(c), ["entity_id"], "month").alias(f"median_{c}")
            for c in ("m2_yoy", "nfci", "fed_assets_yoy")
        ],
    )


@query(
    "expanding_rank",
    "WIN-4",
    compose(
        """SELECT a.entity_id, CAST(a.month AS VARCHAR) AS month, CASE WHEN count(*) > 1
        THEN CAST(count(*) FILTER (WHERE z.cpi_yoy <= a.cpi_yoy) - 1 AS DOUBLE) / (count(*) - 1) ELSE 0.5 END AS rank_pct
        FROM wide a JOIN wide z ON a.entity_id = z.entity_id AND z.month <= a.month GROUP BY a.entity_id, a.month""",
        "wide",
    ),
    "rank_pct",
)
def expanding_rank(spark, sf):
    return _wide(spark, sf).select(
        "entity_id", "month", align.expanding_rank_pct(F.col("cpi_yoy"), ["entity_id"], "month").alias("rank_pct")
    )


@query(
    "publication_lag",
    "WIN-5",
    compose(
        "SELECT entity_id, CAST(month AS VARCHAR) AS month, "
        + ", ".join(
            f"lag({c}, {n}) OVER e AS {c}" if n else c for c, n in align.RELEASE_LAG.items()
        )
        + " FROM spine WINDOW e AS (PARTITION BY entity_id ORDER BY month)",
        "spine",
    ),
    " ".join(INDICATORS),
)
def publication_lag(spark, sf):
    wide = align.align_on_spine(align.to_indicators(_monthly(spark, sf)), require=None)
    return align.publication_lag(wide)


@query(
    "axis_scores",
    "SC-4 SC-25 SC-26 SC-27 SC-28",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, growth_score, inflation_score, liquidity_score,
        g AS growth_direction, i AS inflation_direction FROM raw_regimes""",
        "raw_regimes",
    ),
    "growth_score inflation_score liquidity_score",
)
def axis_scores(spark, sf):
    return regime.scored(_wide(spark, sf)).select(
        "entity_id", "month", "growth_score", "inflation_score", "liquidity_score", "growth_direction", "inflation_direction"
    )


@query(
    "vote_mean_array",
    "SC-4",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, list_avg(list_filter([v_indpro, v_unrate, v_retail,
        v_payrolls], lambda v: v IS NOT NULL)) AS score FROM votes""",
        "votes",
    ),
    "score",
)
def vote_mean_array(spark, sf):
    voted = _wide(spark, sf).select("entity_id", "month", F.array(*regime.growth_votes()).alias("votes"))
    return voted.select("entity_id", "month", labels.vote_mean(F.col("votes")).alias("score"))


@query(
    "confirmation_filter",
    "WIN-9",
    compose("SELECT entity_id, CAST(month AS VARCHAR) AS month, regime_raw, regime FROM anchored", "anchored"),
)
def confirmation_filter(spark, sf):
    raw = regime.scored(_wide(spark, sf)).select(
        "entity_id", "month", labels.family(F.col("growth_direction"), F.col("inflation_direction")).alias("regime_raw")
    )
    return regime.confirmation_filter(raw, ["entity_id"], "month", "regime_raw", "regime")


@query(
    "confirmation_anchors",
    "WIN-9",
    compose("SELECT entity_id, CAST(month AS VARCHAR) AS month, regime_raw, regime FROM anchored", "anchored"),
)
def confirmation_anchors(spark, sf):
    raw = regime.scored(_wide(spark, sf)).select(
        "entity_id", "month", labels.family(F.col("growth_direction"), F.col("inflation_direction")).alias("regime_raw")
    )
    return raw.select(
        "*", regime.confirmation_anchors(F.col("regime_raw"), ["entity_id"], "month").alias("regime")
    )


_REGIME_COLS = (
    "growth_score, inflation_score, liquidity_score, growth_direction, inflation_direction, regime_raw, regime, "
    "liquidity_binary, liquidity_condition, regime_8"
)


@query(
    "regimes",
    "SC-1 SC-2 SC-5",
    compose(f"SELECT entity_id, CAST(month AS VARCHAR) AS month, {_REGIME_COLS} FROM regimes", "regimes"),
    "growth_score inflation_score liquidity_score",
)
def regime_table(spark, sf):
    return regimes(spark, sf).select("entity_id", "month", *_REGIME_COLS.split(", "))


@query(
    "liquidity_conditions",
    "SC-5",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, liquidity_binary, liquidity_condition,
        CASE l_m2 WHEN 1 THEN 'above_trend' WHEN 0 THEN 'below_trend' END AS m2_condition,
        CASE l_nfci WHEN 1 THEN 'looser_than_trend' WHEN 0 THEN 'tighter_than_trend' END AS nfci_condition
        FROM regimes""",
        "regimes",
    ),
)
def liquidity_conditions(spark, sf):
    scored = regime.scored(_wide(spark, sf))
    m2, nfci = regime.liquidity_vote("m2_yoy", False), regime.liquidity_vote("nfci", True)
    out = scored.select(
        "entity_id",
        "month",
        labels.liquidity_binary(F.col("liquidity_score")).alias("liquidity_binary"),
        labels.liquidity_level(F.col("liquidity_score")).alias("liquidity_condition"),
        F.when(m2 == 1, "above_trend").when(m2 == 0, "below_trend").alias("m2_condition"),
        F.when(nfci == 1, "looser_than_trend").when(nfci == 0, "tighter_than_trend").alias("nfci_condition"),
        F.col("growth_score"),
    )
    return out.where(F.col("growth_score").isNotNull()).drop("growth_score")


@query(
    "label_parts",
    "SC-3",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, regime_8, string_split(regime_8, ' — ')[1] AS family,
        regexp_matches(regime_8, '(Ample|Tight) Liquidity$') AS has_suffix FROM regimes""",
        "regimes",
    ),
)
def label_parts(spark, sf):
    return regimes(spark, sf).select(
        "entity_id",
        "month",
        "regime_8",
        labels.family_of(F.col("regime_8")).alias("family"),
        labels.has_liquidity_suffix(F.col("regime_8")).alias("has_suffix"),
    )


@query(
    "signal_detail",
    "SC-29",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, d.axis AS axis, d.indicator AS indicator, d.vote AS vote,
        d.current AS current, d.earlier AS earlier, d.word AS word, d.median AS median FROM (SELECT entity_id, month,
        unnest([
        {'axis': 'growth', 'indicator': 'indpro_yoy', 'vote': v_indpro, 'current': indpro_yoy, 'earlier': e1,
         'word': CASE WHEN v_indpro > 0 THEN 'rising' WHEN v_indpro < 0 THEN 'falling' ELSE 'flat' END, 'median': NULL},
        {'axis': 'growth', 'indicator': 'unrate', 'vote': v_unrate, 'current': unrate, 'earlier': e2,
         'word': CASE WHEN v_unrate > 0 THEN 'falling_good' WHEN v_unrate < 0 THEN 'rising_bad' ELSE 'flat' END,
         'median': NULL},
        {'axis': 'growth', 'indicator': 'retail_yoy', 'vote': v_retail, 'current': retail_yoy, 'earlier': e3,
         'word': CASE WHEN v_retail > 0 THEN 'rising' WHEN v_retail < 0 THEN 'falling' ELSE 'flat' END, 'median': NULL},
        {'axis': 'growth', 'indicator': 'payrolls_yoy', 'vote': v_payrolls, 'current': payrolls_yoy, 'earlier': e4,
         'word': CASE WHEN v_payrolls > 0 THEN 'rising' WHEN v_payrolls < 0 THEN 'falling' ELSE 'flat' END,
         'median': NULL},
        {'axis': 'liquidity', 'indicator': 'm2_yoy', 'vote': l_m2, 'current': m2_yoy, 'earlier': NULL,
         'word': CASE l_m2 WHEN 1 THEN 'above' WHEN 0 THEN 'below' ELSE 'unknown' END, 'median': m_m2},
        {'axis': 'liquidity', 'indicator': 'nfci', 'vote': l_nfci, 'current': nfci, 'earlier': NULL,
         'word': CASE l_nfci WHEN 1 THEN 'below_loose' WHEN 0 THEN 'above_tight' ELSE 'unknown' END, 'median': m_nfci},
        {'axis': 'liquidity', 'indicator': 'fed_assets_yoy', 'vote': l_fed, 'current': fed_assets_yoy, 'earlier': NULL,
         'word': CASE l_fed WHEN 1 THEN 'above' WHEN 0 THEN 'below' ELSE 'unknown' END, 'median': m_fed}]) AS d
        FROM (SELECT *, lag(indpro_yoy, 6) OVER e AS e1, lag(unrate, 6) OVER e AS e2, lag(retail_yoy, 6) OVER e AS e3,
        lag(payrolls_yoy, 6) OVER e AS e4, row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS rn
        FROM votes WINDOW e AS (PARTITION BY entity_id ORDER BY month)) WHERE rn = 1)""",
        "votes",
    ),
    "vote current earlier median",
)
def signal_detail(spark, sf):
    return regime.signal_detail(_wide(spark, sf))


@query(
    "latest_regime",
    "SC-30",
    compose(
        f"""SELECT entity_id, CAST(month AS VARCHAR) AS month, {_REGIME_COLS},
        regime_raw IS NOT DISTINCT FROM regime AS agrees FROM regimes
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) = 1""",
        "regimes",
    ),
    "growth_score inflation_score liquidity_score",
)
def latest_regime(spark, sf):
    table = regimes(spark, sf).select("entity_id", "month", *_REGIME_COLS.split(", "))
    return regime.latest(table)


@query(
    "min_history",
    "FLT-17",
    compose(
        """SELECT entity_id, count(DISTINCT series_id) AS n_series, count(DISTINCT last_day(obs_date)) AS n_months,
        count(DISTINCT series_id) >= 3 AND count(DISTINCT last_day(obs_date)) >= 7 AS enough FROM obs GROUP BY 1""",
        "obs",
    ),
)
def min_history(spark, sf):
    return regime.min_history(b.observations(spark, sf))


@query(
    "iso_weeks",
    "SC-18",
    """SELECT o_orderkey, isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS week
    FROM orders""",
)
def iso_weeks(spark, sf):
    return b.table(spark, sf, "orders").select(
        "o_orderkey", dates.iso_week(F.col("o_orderdate").cast("date")).alias("week")
    )


@query(
    "release_vintage",
    "SC-19",
    """SELECT o_orderkey, CASE WHEN m >= 10 THEN 'Oct ' || y WHEN m >= 4 THEN 'Apr ' || y ELSE 'Oct ' || (y - 1) END
    AS vintage, CAST(CASE WHEN m >= 10 THEN m - 10 WHEN m >= 4 THEN m - 4 ELSE m + 2 END AS BIGINT) AS months_since,
    CASE WHEN m >= 10 THEN m - 10 WHEN m >= 4 THEN m - 4 ELSE m + 2 END > 4 AS stale
    FROM (SELECT o_orderkey, month(o_orderdate) AS m, year(o_orderdate) AS y FROM orders)""",
)
def release_vintage(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        dates.vintage(day).alias("vintage"),
        dates.vintage_age(day).alias("months_since"),
        (dates.vintage_age(day) > 4).alias("stale"),
    )
