"""Registered queries: forward returns by regime, bootstrap, false discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.resample import draw_sql
from tidemark.operators import align, returns as rt
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.panel_queries import regimes
from tidemark.plans.registry import query
from tidemark.session import materialise

WINDOWS = (1, 3, 6)
SPLIT = "1999-12-31"
LAG = 1

cte(
    "emonthly",
    """SELECT entity_id, asset_id, last_day(price_date) AS month, arg_max(close, price_date) AS close FROM eprices
    GROUP BY 1, 2, 3""",
    "eprices",
)


def _fwd_sql(lag: int) -> str:
    parts = [
        f"""SELECT entity_id, asset_id, month, {w} AS "window", (lead(close, {w + lag}) OVER a / lead(close, {lag}) OVER a - 1)
        * 100 AS ret FROM emonthly WINDOW a AS (PARTITION BY entity_id, asset_id ORDER BY month)"""
        for w in WINDOWS
    ]
    return " UNION ALL ".join(parts)


cte("fwd", _fwd_sql(0), "emonthly")
cte("fwd_lagged", _fwd_sql(LAG), "emonthly")
cte("joined", "SELECT * FROM regimes JOIN fwd USING (entity_id, month)", "regimes", "fwd")
cte(
    "unconditional",
    """SELECT entity_id, asset_id, "window", avg(ret) AS mean, stddev_samp(ret) AS std, stddev_samp(ret) / sqrt(count(ret))
    AS se, count(ret) AS n FROM fwd GROUP BY 1, 2, 3 HAVING count(ret) >= 2""",
    "fwd",
)


def entity_monthly(spark, sf):
    return align.resample_last(b.entity_prices(spark, sf), ["entity_id", "asset_id"], "month", "price_date", "close", "month")


def fwd(spark, sf, lag=0):
    return align.forward_return(entity_monthly(spark, sf), WINDOWS, ["entity_id", "asset_id"], execution_lag=lag)


def joined(spark, sf):
    return rt.join_returns(regimes(spark, sf), fwd(spark, sf))


@query(
    "forward_returns",
    "WIN-6 SRC-2",
    compose(
        'SELECT entity_id, asset_id, CAST(month AS VARCHAR) AS month, CAST("window" AS BIGINT) AS "window", ret FROM fwd_lagged',
        "fwd_lagged",
    ),
    "ret",
)
def forward_returns(spark, sf):
    return fwd(spark, sf, LAG)


@query(
    "asof_nearest_prices",
    "JN-1",
    compose(
        """SELECT asset_id, CAST(month AS VARCHAR) AS month, CAST(matched AS VARCHAR) AS matched_time, close FROM (
        SELECT m.asset_id, m.month, p.price_date AS matched, p.close, row_number() OVER (PARTITION BY m.asset_id, m.month
        ORDER BY abs(date_diff('day', p.price_date, m.month)), p.price_date DESC) AS rn FROM (SELECT DISTINCT asset_id,
        last_day(price_date) AS month FROM prices) m LEFT JOIN prices p ON m.asset_id = p.asset_id
        AND p.price_date BETWEEN m.month - 5 AND m.month + 5) WHERE rn = 1""",
        "prices",
    ),
    "close",
)
def asof_nearest_prices(spark, sf):
    prices = b.prices(spark, sf)
    months = prices.select("asset_id", F.last_day("price_date").alias("month")).distinct()
    return align.asof_nearest(months, prices, ["asset_id"], "month", "price_date", ["close"], 5)


@query(
    "asof_year_ago",
    "JN-2",
    compose(
        """SELECT a.asset_id, CAST(a.price_date AS VARCHAR) AS price_date, a.close, CAST(p.price_date AS VARCHAR)
        AS matched_time, p.close AS year_ago FROM (SELECT *, price_date - 365 AS target FROM prices) a ASOF LEFT JOIN prices p
        ON a.asset_id = p.asset_id AND a.target >= p.price_date""",
        "prices",
    ),
    "close year_ago",
)
def asof_year_ago(spark, sf):
    prices = b.prices(spark, sf)
    left = prices.select("asset_id", "price_date", "close", F.date_sub("price_date", 365).alias("target"))
    right = prices.select("asset_id", F.col("price_date").alias("at"), F.col("close").alias("year_ago"))
    return align.asof_backward(left, right, ["asset_id"], "target", "at", ["year_ago"]).drop("target")


@query(
    "regime_returns_join",
    "JN-4",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, asset_id, CAST("window" AS BIGINT) AS "window", regime,
        regime_8, ret FROM joined""",
        "joined",
    ),
    "ret",
)
def regime_returns_join(spark, sf):
    return joined(spark, sf).select("entity_id", "month", "asset_id", "window", "regime", "regime_8", "ret")


@query(
    "unconditional_benchmarks",
    "AGG-2",
    compose('SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", mean, std, se, n FROM unconditional', "unconditional"),
    "mean std se",
)
def unconditional_benchmarks(spark, sf):
    return rt.benchmarks(fwd(spark, sf))


@query(
    "cell_stats",
    "AGG-3",
    compose(
        """SELECT *, abs(excess_vs_se) > 1.0 AS signal FROM (SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window",
        label, c.mean AS mean, median, c.std AS std, win_rate, p25, p75, c.n AS n, c.n < 20 AS low_n,
        u.mean AS unconditional_mean, c.mean - u.mean AS excess, CASE WHEN c.std / sqrt(c.n) > 0 THEN (c.mean - u.mean) /
        (c.std / sqrt(c.n)) WHEN u.mean IS NOT NULL THEN 0.0 END AS excess_vs_se FROM (SELECT entity_id, asset_id, "window",
        regime AS label, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, stddev_samp(ret) AS std, count(ret) AS n,
        avg(CASE WHEN ret > 0 THEN 100.0::DOUBLE WHEN ret IS NOT NULL THEN 0 END) AS win_rate, quantile_cont(ret, 0.25)
        AS p25, quantile_cont(ret, 0.75) AS p75 FROM joined GROUP BY 1, 2, 3, 4 HAVING count(ret) >= 10) c
        LEFT JOIN unconditional u USING (entity_id, asset_id, "window"))""",
        "joined",
        "unconditional",
    ),
    "mean median std win_rate p25 p75 unconditional_mean excess excess_vs_se",
)
def cell_stats(spark, sf):
    returns = materialise(fwd(spark, sf), "forward-returns")
    return rt.cell_stats(rt.join_returns(regimes(spark, sf), returns), "regime", rt.benchmarks(returns))


def _grouped(layer: str, label: str) -> str:
    return f"""SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", '{layer}' AS layer, {label} AS label,
    count(*) AS n_months, count(ret) AS n, CASE WHEN count(ret) >= 10 THEN avg(ret) END AS mean, CASE WHEN count(ret) >= 10
    THEN stddev_samp(ret) END AS std, count(*) < 10 AS insufficient FROM joined WHERE {label} IS NOT NULL
    GROUP BY entity_id, asset_id, "window", {label}"""


@query(
    "grouped_cells",
    "AGG-4",
    compose(
        " UNION ALL ".join(
            [
                _grouped("family", "regime"),
                _grouped("eight", "regime_8"),
                _grouped("family_liquidity", "(regime || ' + ' || liquidity_binary || ' liquidity')"),
            ]
        ),
        "joined",
    ),
    "mean std",
)
def grouped_cells(spark, sf):
    return rt.grouped_cells(joined(spark, sf))


@query(
    "power_analysis",
    "AGG-5",
    compose(
        """SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", regime AS label, stddev_samp(ret) /
        sqrt(count(ret)) * 2.8 AS mde, count(ret) AS n, stddev_samp(ret) AS std FROM joined GROUP BY 1, 2, 3, 4
        HAVING count(ret) >= 5""",
        "joined",
    ),
    "mde std",
)
def power_analysis(spark, sf):
    return rt.power(joined(spark, sf), "regime")


@query(
    "oos_stability",
    "AGG-6 SET-2",
    compose(
        f"""SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", label, CASE WHEN ok THEN 'compared' ELSE
        'missing_in_half' END AS status, CASE WHEN ok THEN a END AS in_mean, CASE WHEN ok THEN z END AS out_mean,
        CASE WHEN ok THEN z - a END AS diff, ok AND same AS same_sign,
        ok AND same AND abs(z - a) < s AS stable FROM (SELECT *, a * z > 0 OR a = 0 OR z = 0 AS same,
        n1 >= 10 AND n2 >= 10 AS ok FROM (SELECT entity_id, asset_id, "window", regime AS label,
        count(ret) FILTER (month <= DATE '{SPLIT}') AS n1, count(ret) FILTER (month > DATE '{SPLIT}') AS n2,
        avg(ret) FILTER (month <= DATE '{SPLIT}') AS a, avg(ret) FILTER (month > DATE '{SPLIT}') AS z,
        stddev_samp(ret) FILTER (month <= DATE '{SPLIT}') AS s FROM joined GROUP BY 1, 2, 3, 4)
        WHERE n1 >= 10 OR n2 >= 10) WHERE entity_id IN (SELECT entity_id FROM joined GROUP BY 1 HAVING
        count(DISTINCT month) FILTER (month <= DATE '{SPLIT}') >= 20 AND
        count(DISTINCT month) FILTER (month > DATE '{SPLIT}') >= 20)""",
        "joined",
    ),
    "in_mean out_mean diff",
)
def oos_stability(spark, sf):
    return rt.stability(materialise(joined(spark, sf), "joined"), SPLIT)


@query(
    "liquidity_value_added",
    "AGG-7",
    compose(
        """SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", label, base_mean, loose_mean, tight_mean,
        abs(loose_mean - tight_mean) AS spread, base_std, CASE WHEN base_std > 0 THEN abs(loose_mean - tight_mean) / base_std
        ELSE 0 END AS information_ratio, abs(loose_mean - tight_mean) > base_std * 0.5 AS matters FROM (SELECT entity_id,
        asset_id, "window", regime AS label, avg(ret) AS base_mean, stddev_samp(ret) AS base_std, count(ret) AS n,
        avg(ret) FILTER (liquidity_binary = 'loose') AS loose_mean, avg(ret) FILTER (liquidity_binary = 'tight') AS tight_mean,
        count(ret) FILTER (liquidity_binary = 'loose') AS nl, count(ret) FILTER (liquidity_binary = 'tight') AS nt
        FROM joined WHERE "window" = 3 GROUP BY 1, 2, 3, 4) WHERE n >= 10 AND nl >= 10 AND nt >= 10""",
        "joined",
    ),
    "base_mean loose_mean tight_mean spread base_std information_ratio",
)
def liquidity_value_added(spark, sf):
    return rt.liquidity_value(joined(spark, sf))


@query(
    "transition_returns",
    "AGG-8",
    compose(
        """SELECT entity_id, prior, regime, asset_id, count(*) AS n_transitions, CASE WHEN count(ret) >= 2 THEN avg(ret) END
        AS mean, count(ret) AS n FROM (SELECT entity_id, month, regime, lag(regime) OVER (PARTITION BY entity_id
        ORDER BY month) AS prior FROM regimes) JOIN fwd USING (entity_id, month) WHERE prior <> regime AND "window" = 3
        GROUP BY 1, 2, 3, 4""",
        "regimes",
        "fwd",
    ),
    "mean",
)
def transition_returns(spark, sf):
    return rt.transition_returns(regimes(spark, sf), fwd(spark, sf))


cte(
    "boot_cells",
    """SELECT entity_id, asset_id, "window", regime AS label, list(ret ORDER BY month) AS v, count(*) AS n, avg(ret) AS mean
    FROM joined WHERE ret IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= 15 AND stddev_pop(ret) >= 1e-6""",
    "joined",
)
_AT = draw_sql('greatest(1, n - "window" + 1)', "42", "b", '(i // "window")')
cte(
    "boot_means",
    f"""SELECT entity_id, asset_id, "window", label, b, avg(v[{_AT} + i % "window" + 1]) AS m FROM (
    SELECT *, unnest(range(n)) AS i FROM (SELECT *, unnest(range(1, 1001)) AS b FROM boot_cells)) GROUP BY 1, 2, 3, 4, 5""",
    "boot_cells",
)
cte(
    "boot",
    """SELECT *, u < ci_low OR u > ci_high AS significant FROM (SELECT entity_id, asset_id, "window", label, c.n AS n,
    c.mean AS mean, u.mean AS u, quantile_cont(m, 0.05) AS ci_low, quantile_cont(m, 0.95) AS ci_high,
    least(1.0, avg(CASE WHEN CASE WHEN c.mean >= u.mean THEN m <= u.mean ELSE m >= u.mean END THEN 2.0::DOUBLE ELSE 0 END))
    AS p_value FROM boot_means JOIN boot_cells c USING (entity_id, asset_id, "window", label)
    JOIN unconditional u USING (entity_id, asset_id, "window") GROUP BY 1, 2, 3, 4, 5, 6, 7)""",
    "boot_means",
    "unconditional",
)
cte(
    "bh",
    """SELECT *, coalesce(rk <= max(CASE WHEN p_value <= rk * 0.10 / m THEN rk END) OVER (PARTITION BY entity_id), false)
    AS bh_significant FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY p_value, asset_id, "window", label)
    AS rk, count(*) OVER (PARTITION BY entity_id) AS m FROM boot)""",
    "boot",
)


def boot(spark, sf):
    returns = materialise(fwd(spark, sf), "forward-returns")
    pairs = rt.join_returns(regimes(spark, sf), returns)
    return rt.bootstrap_mean(pairs, "regime", rt.benchmarks(returns))


def flagged(spark, sf):
    return rt.benjamini_hochberg(boot(spark, sf), "p_value", ["entity_id"], tie=["asset_id", "window", "label"])


@query(
    "bootstrap_significance",
    "AGG-18 AGG-20",
    compose(
        """SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", label, n, mean, u AS unconditional_mean, ci_low,
        ci_high, p_value, significant, bh_significant FROM bh""",
        "bh",
    ),
    "mean unconditional_mean ci_low ci_high p_value",
)
def bootstrap_significance(spark, sf):
    return flagged(spark, sf)


@query(
    "significance_summary",
    "AGG-21",
    compose(
        """SELECT entity_id, count(*) AS n_tested, count(*) FILTER (bh_significant) AS n_significant,
        count(*) FILTER (bh_significant) * 100.0::DOUBLE / count(*) AS pct_significant,
        count(*) FILTER (bh_significant) * 100.0::DOUBLE / count(*) < 25 AS underpowered FROM bh GROUP BY 1""",
        "bh",
    ),
    "pct_significant",
)
def significance_summary(spark, sf):
    return rt.significance_summary(flagged(spark, sf), ["entity_id"])
