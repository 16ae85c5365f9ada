"""Shared SQL pieces of the oracle: named common table expressions with their dependencies."""

from __future__ import annotations

from collections.abc import Callable

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (deps, body)


def compose(body: str, *names: str) -> Callable[[], str]:
    """Deferred SQL: a ``WITH`` clause holding ``names`` and all they need, followed by ``body``."""
    return lambda: _text(body, names)


def _text(body: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    clause = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {clause}\n{body}"


cte(
    "eorders",
    """SELECT o_orderkey, o_custkey, CAST(c_nationkey AS VARCHAR) AS entity_id, o_totalprice, o_orderpriority,
    o_orderstatus, CAST(o_orderdate AS DATE) AS o_date FROM orders JOIN customer ON o_custkey = c_custkey""",
)
cte(
    "elines",
    """SELECT lineitem.*, CAST(l_shipdate AS DATE) AS day, entity_id
    FROM lineitem JOIN eorders ON l_orderkey = o_orderkey""",
    "eorders",
)
cte(
    "daily",
    """SELECT entity_id, day, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, count(*) AS n,
    sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax,
    sum(l_extendedprice / l_quantity) AS unit,
    sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / l_quantity END) AS core_unit,
    count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS core_n FROM elines GROUP BY entity_id, day""",
    "elines",
)
cte(
    "flows",
    """SELECT entity_id, last_day(day) AS obs_date, sum(qty) AS qty, round(sum(price), 2) AS price,
    CAST(sum(n) AS DOUBLE) AS n FROM daily GROUP BY entity_id, last_day(day)""",
    "daily",
)
cte(
    "obs",
    """SELECT entity_id, 'INDPRO' AS series_id, obs_date, qty AS value FROM flows
    UNION ALL SELECT entity_id, 'M2SL', obs_date, price FROM flows
    UNION ALL SELECT entity_id, 'WALCL', obs_date, n FROM flows
    UNION ALL SELECT entity_id, 'UNRATE', day, CAST(disc AS DOUBLE) / n FROM daily
    UNION ALL SELECT entity_id, 'CPIAUCSL', day, round(unit / n, 6) FROM daily
    UNION ALL SELECT entity_id, 'CPILFESL', day, round(core_unit / core_n, 6) FROM daily WHERE core_n > 0
    UNION ALL SELECT entity_id, 'NFCI', day, CAST(tax AS DOUBLE) / n FROM daily
    UNION ALL SELECT entity_id, 'RSAFS', last_day(o_date), round(sum(o_totalprice), 2) FROM eorders GROUP BY 1, 3
    UNION ALL SELECT entity_id, 'PAYEMS', last_day(o_date), CAST(count(DISTINCT o_custkey) AS DOUBLE)
    FROM eorders GROUP BY 1, 3""",
    "flows",
    "daily",
    "eorders",
)
cte(
    "monthly",
    """SELECT entity_id, series_id, last_day(obs_date) AS month, arg_max(value, obs_date) AS value
    FROM obs GROUP BY entity_id, series_id, last_day(obs_date)""",
    "obs",
)
cte(
    "indicator_names",
    """SELECT * FROM (VALUES ('INDPRO', 'indpro_yoy', 1, 1, 2), ('UNRATE', 'unrate', 0, 2, 1),
    ('RSAFS', 'retail_yoy', 1, 3, 2), ('PAYEMS', 'payrolls_yoy', 1, 4, 1), ('CPIAUCSL', 'cpi_yoy', 1, 5, 1),
    ('CPILFESL', 'core_cpi_yoy', 1, 6, 1), ('M2SL', 'm2_yoy', 1, 7, 2), ('NFCI', 'nfci', 0, 8, 0),
    ('WALCL', 'fed_assets_yoy', 1, 9, 0)) t(series_id, indicator, is_level, priority, release_lag)""",
)
cte(
    "indicators",
    """SELECT entity_id, month, indicator, priority, release_lag, CASE WHEN is_level = 1 THEN (value / lag(value, 12)
    OVER (PARTITION BY entity_id, series_id ORDER BY month) - 1) * 100 ELSE value END AS value
    FROM monthly JOIN indicator_names USING (series_id)""",
    "monthly",
    "indicator_names",
)
_NAMES = (
    "indpro_yoy", "unrate", "retail_yoy", "payrolls_yoy", "cpi_yoy", "core_cpi_yoy", "m2_yoy", "nfci", "fed_assets_yoy",
)
_PIVOT = ", ".join(f"max(CASE WHEN indicator = '{n}' THEN value END) AS {n}" for n in _NAMES)
cte(
    "spine",
    f"""SELECT entity_id, month, {_PIVOT} FROM (SELECT *, priority = min(priority) OVER (PARTITION BY entity_id) AS sp
    FROM indicators) GROUP BY entity_id, month HAVING bool_or(sp)""",
    "indicators",
)
cte("wide", "SELECT * FROM spine WHERE cpi_yoy IS NOT NULL", "spine")


def _vote(c: str, invert: bool) -> str:
    d = f"({c} - lag({c}, 6) OVER e)"
    return f"CAST(sign({'-' if invert else ''}{d}) AS DOUBLE)"


def _liq(c: str, invert: bool) -> tuple[str, str]:
    frame = "OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"
    med = f"CASE WHEN count({c}) {frame} >= 12 THEN quantile_cont({c}, 0.5) {frame} END"
    op = "<" if invert else ">"
    return med, f"CASE WHEN ({med}) IS NOT NULL THEN CASE WHEN {c} {op} ({med}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END"


def mean_of(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in cols)
    count = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    return f"CASE WHEN {count} > 0 THEN ({total}) / ({count}) END"


cte(
    "votes",
    f"""SELECT *, {_vote('indpro_yoy', False)} AS v_indpro, {_vote('unrate', True)} AS v_unrate,
    {_vote('retail_yoy', False)} AS v_retail, {_vote('payrolls_yoy', False)} AS v_payrolls,
    cpi_yoy - lag(cpi_yoy, 6) OVER e AS d_cpi, core_cpi_yoy - lag(core_cpi_yoy, 6) OVER e AS d_core,
    bool_or(core_cpi_yoy IS NOT NULL) OVER (PARTITION BY entity_id) AS has_core,
    {_liq('m2_yoy', False)[0]} AS m_m2, {_liq('nfci', True)[0]} AS m_nfci, {_liq('fed_assets_yoy', False)[0]} AS m_fed,
    {_liq('m2_yoy', False)[1]} AS l_m2, {_liq('nfci', True)[1]} AS l_nfci, {_liq('fed_assets_yoy', False)[1]} AS l_fed
    FROM wide WINDOW e AS (PARTITION BY entity_id ORDER BY month)""",
    "wide",
)
cte(
    "scores",
    f"""SELECT *, {mean_of(['v_indpro', 'v_unrate', 'v_retail', 'v_payrolls'])} AS growth_score,
    CASE WHEN has_core THEN (coalesce(d_cpi, 0) + coalesce(d_core, 0)) / 2 ELSE coalesce(d_cpi, 0) END AS inflation_score,
    {mean_of(['l_m2', 'l_nfci', 'l_fed'])} AS liquidity_score FROM votes""",
    "votes",
)
cte(
    "raw_regimes",
    """SELECT *, CASE WHEN g = 'rising' AND i = 'falling' THEN 'Goldilocks' WHEN g = 'rising' AND i = 'rising'
    THEN 'Overheating' WHEN g = 'falling' AND i = 'falling' THEN 'Disinflationary Slowdown'
    WHEN g = 'falling' AND i = 'rising' THEN 'Stagflation' END AS regime_raw FROM (SELECT *,
    CASE WHEN growth_score > 0 THEN 'rising' WHEN growth_score IS NOT NULL THEN 'falling' END AS g,
    CASE WHEN inflation_score > 0 THEN 'rising' WHEN inflation_score IS NOT NULL THEN 'falling' END AS i FROM scores)""",
    "scores",
)
cte(
    "anchored",
    """SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY month
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS regime FROM (SELECT *, CASE WHEN regime_raw = lag(regime_raw)
    OVER e OR count(regime_raw) OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) = 0 THEN regime_raw END AS anchor FROM raw_regimes
    WINDOW e AS (PARTITION BY entity_id ORDER BY month))""",
    "raw_regimes",
)
cte(
    "regimes",
    """SELECT *, CASE WHEN liquidity_binary IS NULL THEN regime ELSE regime || ' — ' || CASE WHEN liquidity_binary =
    'loose' THEN 'Ample' ELSE 'Tight' END || ' Liquidity' END AS regime_8 FROM (SELECT *, g AS growth_direction,
    i AS inflation_direction, CASE WHEN liquidity_score > 0.5 THEN 'loose' WHEN liquidity_score IS NOT NULL THEN 'tight'
    END AS liquidity_binary, CASE WHEN liquidity_score >= 0.8 THEN 'strong_loose' WHEN liquidity_score > 0.5 THEN 'loose'
    WHEN liquidity_score > 0.2 THEN 'tight' ELSE 'strong_tight' END AS liquidity_condition FROM anchored)
    WHERE regime IS NOT NULL""",
    "anchored",
)
cte(
    "prices",
    """SELECT p_brand AS asset_id, CAST(l_shipdate AS DATE) AS price_date, round(sum(l_extendedprice / l_quantity)
    / count(*), 6) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2""",
)
cte(
    "eprices",
    """SELECT entity_id, p_type AS asset_id, day AS price_date, round(sum(l_extendedprice / l_quantity) / count(*), 6)
    AS close FROM elines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "elines",
)
