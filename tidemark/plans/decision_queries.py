"""Registered queries: templates, limits, reconciliation, gates, verdicts, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import TEMPLATES, TILT_GROUPS, TILTS
from tidemark.functions import labels as L
from tidemark.operators import align, decisions as dc, portfolio as pf, regime, signals as sg, transitions as tr
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.panel_queries import _wide, regimes
from tidemark.plans.portfolio_queries import _SPREAD, _valued
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.plans.transition_queries import counts4, shrunk

cte(
    "latest",
    "SELECT * FROM regimes QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) = 1",
    "regimes",
)
_TEMPLATE = ", ".join(f"('{f}', '{bk}', '{s}', {float(w)})" for f, rows in TEMPLATES.items() for bk, s, w in rows)
_TILT = ", ".join(f"('{side}', '{s}', {TILTS[side][g]})" for side in TILTS for g, symbols in TILT_GROUPS.items() for s in symbols)
cte(
    "template_rows",
    f"""SELECT entity_id, regime, liquidity_binary, bucket, symbol, weight::DOUBLE AS weight, CASE WHEN weight > 0 THEN
    coalesce(tilt, 0.0) ELSE 0.0 END::DOUBLE AS tilt FROM latest JOIN (VALUES {_TEMPLATE}) t(regime, bucket, symbol, weight) USING (regime)
    LEFT JOIN (VALUES {_TILT}) k(side, symbol, tilt) USING (symbol) WHERE side IS NULL OR (side = 'ample') = (liquidity_binary = 'loose')
    OR liquidity_binary IS NULL AND side = 'ample'""",
    "latest",
)


def _latest(spark, sf):
    return regime.latest(regimes(spark, sf).select("entity_id", "month", "regime_raw", "regime", "liquidity_binary", "regime_8"))


def _template(spark, sf):
    rows = dc.template_rows(_latest(spark, sf).select("entity_id", "regime", "liquidity_binary"))
    return rows


@query(
    "template_join",
    "JN-10",
    compose("SELECT entity_id, regime, liquidity_binary, bucket, symbol, weight, tilt FROM template_rows", "template_rows"),
    "weight tilt",
)
def template_join(spark, sf):
    return _template(spark, sf)


@query(
    "tilted_template",
    "PF-1",
    compose(
        """SELECT entity_id, regime, liquidity_binary, bucket, symbol, weight, tilt, w / sum(w) OVER (PARTITION BY entity_id) * 95 AS
        target_pct FROM (SELECT *, greatest(CASE WHEN symbol = 'SGOV' AND weight > 0 THEN 2 ELSE 0 END, weight + tilt) AS w
        FROM template_rows)""",
        "template_rows",
    ),
    "weight tilt target_pct",
)
def tilted_template(spark, sf):
    return dc.tilted_template(_template(spark, sf), ["entity_id"])


_ETF = {"ECONOMY": "SPY", "STANDARD": "TLT", "MEDIUM": "GLD", "SMALL": "IWM", "LARGE": "QQQ", "PROMO": "HYG"}
_ETF_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ETF.items()) + " END"
_STATUS = ("DRAFT", "ACTIVE", "STRENGTHENING", "WEAKENING")
_STATUS_SQL = "CASE WHEN p_size = 50 THEN 'INVALIDATED' ELSE ['DRAFT', 'ACTIVE', 'STRENGTHENING', 'WEAKENING'][p_size % 4 + 1] END"
cte(
    "theses",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS thesis_id, {_STATUS_SQL} AS status, {_ETF_SQL} AS etf, p_brand, p_size % 5 + 1 AS lo,
    p_size % 5 + 3 AS hi, p_size FROM part""",
)


def _theses(spark, sf):
    size = F.col("p_size")
    status = F.when(size == 50, "INVALIDATED").otherwise(F.array(*[F.lit(s) for s in _STATUS])[size % 4])
    etf = F.create_map(*[F.lit(x) for item in _ETF.items() for x in item])[F.col("p_type")]
    sizing = F.concat(F.lit("medium "), (size % 5 + 1).cast("string"), F.lit("-"), (size % 5 + 3).cast("string"), F.lit("%"))
    row = lambda s, n: F.struct(s.alias("symbol"), sizing.alias("sizing"), F.lit(n).alias("expression_order"))
    return b.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("thesis_id"),
        status.alias("status"),
        etf.alias("etf"),
        size.alias("size"),
        F.array(row(etf, 1), row(F.col("p_brand"), 2)).alias("expressions"),
    )


@query(
    "tradeable_theses",
    "FLT-12",
    compose(
        """SELECT thesis_id, status, CASE WHEN status IN ('ACTIVE', 'STRENGTHENING') THEN 1.0 WHEN status = 'WEAKENING' THEN 0.5 ELSE 0
        END::DOUBLE AS size_factor, status IN ('ACTIVE', 'STRENGTHENING', 'WEAKENING') AS tradeable, status = 'INVALIDATED' AS exit
        FROM theses""",
        "theses",
    ),
    "size_factor",
)
def tradeable_theses(spark, sf):
    factor = dc.tradeable(F.col("status"))
    return _theses(spark, sf).select(
        "thesis_id", "status", factor.alias("size_factor"), (factor > 0).alias("tradeable"), (F.col("status") == "INVALIDATED").alias("exit")
    )


@query(
    "thesis_overlay",
    "PF-2",
    compose(
        """SELECT thesis_id, status, CASE o WHEN 1 THEN etf ELSE p_brand END AS symbol, CAST(o AS BIGINT) AS expression_order, CASE status
        WHEN 'STRENGTHENING' THEN hi WHEN 'WEAKENING' THEN lo ELSE (lo + hi) / 2 END::DOUBLE AS size_pct, true AS tradeable
        FROM theses, (VALUES (1), (2)) e(o) WHERE status IN ('ACTIVE', 'STRENGTHENING', 'WEAKENING')""",
        "theses",
    ),
    "size_pct",
)
def thesis_overlay(spark, sf):
    return dc.thesis_overlay(_theses(spark, sf))


@query(
    "halved_templates",
    "PF-2",
    compose(
        """SELECT entity_id, symbol, bucket, weight, a.etf IS NOT NULL AS conflict, CASE WHEN a.etf IS NOT NULL THEN weight / 2 ELSE weight END
        AS adjusted FROM template_rows LEFT JOIN (SELECT DISTINCT etf FROM theses WHERE status = 'WEAKENING' AND p_size > 45) a
        ON symbol = a.etf""",
        "template_rows",
        "theses",
    ),
    "weight adjusted",
)
def halved_templates(spark, sf):
    avoided = _theses(spark, sf).where((F.col("status") == "WEAKENING") & (F.col("size") > 45)).select(F.col("etf").alias("symbol"))
    rows = _template(spark, sf).select("entity_id", "symbol", "bucket", "weight")
    return dc.halve_avoided(rows, avoided)


cte(
    "limited",
    """SELECT *, p3 * least(1.0, 95 / sum(p3) OVER (PARTITION BY account_id)) AS limited_pct FROM (SELECT *, CASE WHEN thesis <> '' THEN p2 *
    least(1.0, 25.0 / sum(CASE WHEN thesis <> '' THEN p2 ELSE 0 END) OVER (PARTITION BY account_id)) ELSE p2 END AS p3 FROM (SELECT *,
    CASE WHEN sector IS NOT NULL THEN p1 * least(1.0, 0.3 * sum(CASE WHEN sector IS NOT NULL THEN p1 END) OVER (PARTITION BY account_id) /
    sum(p1) OVER (PARTITION BY account_id, sector)) ELSE p1 END AS p2 FROM (SELECT account_id, symbol, sector, thesis, allocation_pct AS
    target_pct, least(allocation_pct, 15) AS p1 FROM valued)))""",
    "valued",
)


@query(
    "risk_limits",
    "PF-3",
    compose(
        """SELECT account_id, symbol, sector, thesis, target_pct, limited_pct, concat_ws(',', CASE WHEN p1 < target_pct - 1e-9 THEN 'position'
        END, CASE WHEN p2 < p1 - 1e-9 THEN 'sector' END, CASE WHEN p3 < p2 - 1e-9 THEN 'overlay' END, CASE WHEN limited_pct < p3 - 1e-9 THEN
        'cash' END) AS corrections, coalesce(sum(CASE WHEN sector IS NOT NULL THEN limited_pct END) OVER (PARTITION BY account_id, sector) /
        sum(CASE WHEN sector IS NOT NULL THEN limited_pct END) OVER (PARTITION BY account_id) > 0.3 + 1e-6, false) AS residual_sector
        FROM limited""",
        "limited",
    ),
    "target_pct limited_pct",
)
def risk_limits(spark, sf):
    target = _valued(spark, sf, cols=("symbol", "sector", "thesis")).select("account_id", "symbol", "sector", "thesis", F.col("allocation_pct").alias("target_pct"))
    return dc.apply_limits(target)


def _share_sql(where: str) -> str:
    return f"""SELECT account_id, symbol, v / sum(v) OVER (PARTITION BY account_id) * 100 AS pct FROM (SELECT CAST(o_custkey AS VARCHAR) AS
    account_id, CAST(l_partkey AS VARCHAR) AS symbol, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where}
    GROUP BY 1, 2)"""


cte("current_share", _share_sql("o_orderstatus = 'F'"))
cte("target_share", _share_sql("o_orderstatus <> 'F'"))
cte(
    "target_current",
    """SELECT account_id, symbol, coalesce(t.pct, 0) AS target_pct, coalesce(c.pct, 0) AS current_pct FROM target_share t FULL JOIN
    current_share c USING (account_id, symbol)""",
    "target_share",
    "current_share",
)


def _shares(spark, sf):
    """Target and current share of each (account, symbol), from one pass over the lines."""
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.col("o_orderstatus") == "F").alias("filled")
    )
    lots = b.table(spark, sf, "lineitem").join(orders, "l_orderkey").groupBy(
        F.col("o_custkey").cast("string").alias("account_id"), F.col("l_partkey").cast("string").alias("symbol")
    ).agg(F.sum(F.when(F.col("filled"), F.col("l_quantity"))).alias("current"), F.sum(F.when(~F.col("filled"), F.col("l_quantity"))).alias("target"))
    lots = materialise(lots, "lots")
    total = lots.groupBy("account_id").agg(F.sum("current").alias("_c"), F.sum("target").alias("_t"))
    both = lots.join(total, "account_id")
    side = lambda v, t: both.where(F.col(v).isNotNull()).select("account_id", "symbol", (F.col(v) / F.col(t) * 100).alias("pct"))
    return side("target", "_t"), side("current", "_c")


def _both(spark, sf):
    return dc.target_vs_current(*_shares(spark, sf))


@query(
    "target_vs_current",
    "JN-11",
    compose("SELECT *, target_pct - current_pct AS delta_pct FROM target_current", "target_current"),
    "target_pct current_pct delta_pct",
)
def target_vs_current(spark, sf):
    return _both(spark, sf)


@query(
    "reconciliation",
    "PF-4",
    compose(
        """SELECT account_id, symbol, CASE WHEN killed THEN 0 ELSE target_pct END AS target_pct, current_pct, delta_pct, CASE WHEN killed THEN
        'EXIT_KILL_SWITCH' WHEN current_pct = 0 AND target_pct > 0 THEN 'NEW_POSITION' WHEN current_pct > 0 AND target_pct = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'SELL_SOME' ELSE 'CLOSE' END
        WHEN delta_pct > 1e-9 THEN 'BUY_MORE' WHEN delta_pct < -1e-9 THEN 'SELL_SOME' ELSE 'HOLD' END AS action, CASE WHEN killed THEN 'URGENT'
        WHEN abs(delta_pct) < 1 THEN 'LOW' ELSE 'NORMAL' END AS priority, CASE WHEN current_pct > 0 AND target_pct = 0 THEN CASE WHEN killed THEN
        'kill switch' WHEN p_size % 3 > 0 THEN 'thesis closed' ELSE 'prior regime' END ELSE '' END AS orphan_reason FROM (SELECT *, CASE WHEN
        killed THEN -current_pct ELSE target_pct - current_pct END AS delta_pct FROM (SELECT t.*, p_size, p_size = 50 AND current_pct > 0
        AS killed FROM target_current t JOIN part ON symbol = CAST(p_partkey AS VARCHAR)))""",
        "target_current",
    ),
    "target_pct current_pct delta_pct",
)
def reconciliation(spark, sf):
    size = F.col("p_size")
    part = b.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("symbol"), "p_size")
    layer = F.when(size % 3 == 0, "regime").when(size % 3 == 1, "thesis_tactical").otherwise("thesis_structural")
    return dc.reconcile(_both(spark, sf).join(part, "symbol"), size == 50, layer)


@query(
    "orphaned_positions",
    "SET-4",
    compose(
        """SELECT 'orphan' AS kind, account_id, symbol FROM current_share ANTI JOIN target_share USING (account_id, symbol) UNION ALL SELECT
        'new', account_id, symbol FROM target_share ANTI JOIN current_share USING (account_id, symbol)""",
        "current_share",
        "target_share",
    ),
)
def orphaned_positions(spark, sf):
    target, current = _shares(spark, sf)
    keys = ["account_id", "symbol"]
    only = lambda kind, a, z: a.join(z, keys, "left_anti").select(F.lit(kind).alias("kind"), *keys)
    return only("orphan", current, target).unionByName(only("new", target, current))


RULES = [
    ("weak labour", "UNRATE", ">", 5.5, 2),
    ("loose conditions", "NFCI", "<", 4.5, 1),
    ("few customers", "PAYEMS", "<", 3.0, 2),
    ("volume surge", "INDPRO", ">", 900.0, 1),
    ("price surge", "CPIAUCSL", ">", 20000.0, 2),
]
_RULES_SQL = ", ".join(f"('{n}', '{s}', '{o}', {t}, {c})" for n, s, o, t, c in RULES)


@query(
    "kill_switches",
    "PF-5",
    compose(
        f"""SELECT *, CASE proximity WHEN 'TRIGGERED' THEN 'EXIT_IMMEDIATELY' WHEN 'FAR' THEN 'none' ELSE 'monitor' END AS action FROM (SELECT
        entity_id, rule, series_id, value, streak, CASE WHEN streak >= consecutive THEN 'TRIGGERED' WHEN r >= 0.8 THEN 'NEAR' WHEN r >= 0.6
        THEN 'APPROACHING' ELSE 'FAR' END AS proximity FROM (SELECT *, CASE WHEN op = '>' THEN value / threshold WHEN value <> 0 THEN
        threshold / value END AS r FROM (SELECT entity_id, rule, series_id, op, threshold, consecutive, max(value) FILTER (pos = 1) AS value,
        coalesce(min(pos) FILTER (NOT hit), count(*) + 1) - 1 AS streak FROM (SELECT *, CASE WHEN op = '>' THEN value > threshold ELSE value <
        threshold END AS hit, row_number() OVER (PARTITION BY entity_id, rule ORDER BY month DESC) AS pos FROM monthly JOIN (VALUES {_RULES_SQL})
        r(rule, series_id, op, threshold, consecutive) USING (series_id)) GROUP BY 1, 2, 3, 4, 5, 6)))""",
        "monthly",
    ),
    "value",
)
def kill_switches(spark, sf):
    return dc.kill_switches(RULES, align.resample_last(b.observations(spark, sf)))


@query(
    "scale_in",
    "PF-6",
    compose(
        """SELECT account_id, symbol, delta_pct, CASE WHEN abs(delta_pct) < 1 THEN 'skip' WHEN abs(delta_pct) > 3 THEN 'split' ELSE 'trade' END AS
        mode, CASE WHEN abs(delta_pct) < 1 THEN 0 ELSE delta_pct * CASE WHEN status = 'STRENGTHENING' AND run = 1 THEN 0.75 WHEN layer =
        'thesis_structural' AND run = 1 THEN 0.33 WHEN layer = 'thesis_structural' AND run = 2 THEN 0.66 WHEN layer = 'thesis_tactical' AND
        run = 1 THEN 0.5 WHEN layer = 'regime' AND run = 1 AND regime = 'Stagflation' THEN 0.75 WHEN layer = 'regime' AND run = 1 THEN 0.5 ELSE
        1 END END AS execute_pct FROM (SELECT account_id, symbol, allocation_pct - 2.5 AS delta_pct, layer, CASE WHEN size % 4 = 2 THEN
        'STRENGTHENING' ELSE 'ACTIVE' END AS status, size % 5 % 3 + 1 AS run, CASE WHEN size % 7 = 0 THEN 'Stagflation' ELSE 'Goldilocks' END
        AS regime FROM positions)""",
        "positions",
    ),
    "delta_pct execute_pct",
)
def scale_in(spark, sf):
    size = F.col("size")
    orders = b.positions(spark, sf).select(
        "account_id",
        "symbol",
        (F.col("allocation_pct") - 2.5).alias("delta_pct"),
        "layer",
        F.when(size % 4 == 2, "STRENGTHENING").otherwise("ACTIVE").alias("status"),
        (size % 5 % 3 + 1).alias("run"),
        F.when(size % 7 == 0, "Stagflation").otherwise("Goldilocks").alias("regime"),
    )
    return dc.scale_in(orders).select("account_id", "symbol", "delta_pct", "mode", "execute_pct")


_CONVICTION = {"view": "neutral", "click": "favor", "signup": "bull", "error": "bear"}


@query(
    "retry_gate",
    "PF-7",
    """SELECT account_id, event_id, retry_count, gate, CASE WHEN gate = 'retry' THEN (retry_count + 1) * 0.3::DOUBLE END AS widen_pct FROM (SELECT
    *, CASE WHEN retry_count < 2 THEN 'retry' WHEN event_type = 'error' THEN 'market' WHEN event_type IN ('click', 'signup') THEN 'retry' ELSE
    'skip' END AS gate FROM (SELECT account_id, event_id, event_type, CAST(cum - open - coalesce(max(base) OVER (PARTITION BY account_id ORDER BY
    ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS retry_count FROM (SELECT *, CASE WHEN open = 0 THEN cum END
    AS base FROM (SELECT *, sum(open) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT
    CAST(user_id AS VARCHAR) AS account_id, event_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS open FROM events)))))""",
    "widen_pct",
)
def retry_gate(spark, sf):
    at, _ = b.event_order()
    counted = pf.retry_count(b.events(spark, sf), ["account_id"], at, "event_id", F.col("event_type") == "purchase")
    names = F.create_map(*[F.lit(x) for item in _CONVICTION.items() for x in item])
    orders = counted.select("account_id", "event_id", "retry_count", F.coalesce(names[F.col("event_type")], F.lit("neutral")).alias("conviction"))
    return dc.retry_gate(orders).drop("conviction")


@query(
    "layered_retry_gate",
    "PF-7",
    """SELECT account_id, event_id, judged_by, gate, CASE WHEN gate = 'retry' THEN (retry_count + 1) * 0.3::DOUBLE END AS widen_pct FROM (SELECT *, CASE WHEN priority
    <= 2 AND side = 'sell' THEN 'market' WHEN retry_count < 2 THEN 'retry' WHEN judged_by IN ('bear', 'strong sell') AND side = 'sell' THEN 'market' WHEN judged_by IN
    ('favor', 'bull') THEN 'retry' ELSE 'skip' END AS gate FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 4 < 2 THEN 'favor' ELSE 'neutral' END
    ELSE coalesce(signal, 'neutral') END AS judged_by FROM (SELECT account_id, event_id, event_id % 7 AS priority, CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END
    AS side, CASE event_type WHEN 'error' THEN 'bear' WHEN 'click' THEN 'favor' WHEN 'signup' THEN 'bull' WHEN 'view' THEN 'avoid' END AS signal, CAST(cum - open -
    coalesce(max(base) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS retry_count FROM (SELECT *,
    CASE WHEN open = 0 THEN cum END AS base FROM (SELECT *, sum(open) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT
    CAST(user_id AS VARCHAR) AS account_id, event_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS open FROM events))))))""",
    "widen_pct",
)
def layered_retry_gate(spark, sf):
    at, _ = b.event_order()
    counted = pf.retry_count(b.events(spark, sf), ["account_id"], at, "event_id", F.col("event_type") == "purchase")
    n, signals = F.col("event_id"), F.create_map(*[F.lit(x) for x in ("error", "bear", "click", "favor", "signup", "bull", "view", "avoid")])
    orders = counted.select(
        "account_id", "event_id", "retry_count", F.when(n % 2 == 0, "sell").otherwise("buy").alias("side"), (n % 7).alias("priority"),
        F.element_at(F.array(*[F.lit(x) for x in ("regime", "thesis_tactical", "thesis_structural")]), (n % 3 + 1).cast("int")).alias("layer"),
        F.element_at(F.array(*[F.lit(x) for x in ("ACTIVE", "STRENGTHENING", "WEAKENING", "APPROACHING")]), (n % 4 + 1).cast("int")).alias("status"),
        F.try_element_at(signals, F.col("event_type")).alias("signal"),
    )
    return dc.layered_retry_gate(orders).select("account_id", "event_id", "judged_by", "gate", "widen_pct")


@query(
    "buying_power_scale",
    "PF-8",
    compose(
        """SELECT account_id, symbol, s AS scale, cost * s AS scaled_cost FROM (SELECT *, least(1.0, greatest(0.0, cash) / sum(cost) OVER
        (PARTITION BY account_id)) AS s FROM (SELECT account_id, symbol, market_value AS cost, cash FROM positions WHERE size % 2 = 0))""",
        "positions",
    ),
    "scale scaled_cost",
)
def buying_power_scale(spark, sf):
    buys = b.positions(spark, sf).where(F.col("size") % 2 == 0).select("account_id", "symbol", F.col("market_value").alias("cost"), "cash")
    return dc.buying_power_scale(buys).select("account_id", "symbol", "scale", "scaled_cost")


@query(
    "drawdown_raise",
    "PF-9",
    compose(
        """SELECT account_id, symbol, cash_before, cash_before < 25 AS close FROM (SELECT account_id, symbol, coalesce(sum(allocation_pct) OVER
        (PARTITION BY account_id ORDER BY conviction, size, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + cash_pct AS cash_before
        FROM (SELECT *, cash / portfolio_value * 100 AS cash_pct, CASE layer WHEN 'thesis_structural' THEN 1 WHEN 'thesis_tactical' THEN 2 ELSE 3
        END AS conviction FROM positions))""",
        "positions",
    ),
    "cash_before",
)
def drawdown_raise(spark, sf):
    layer = F.col("layer")
    held = b.positions(spark, sf, "account_id", "symbol", "allocation_pct", "size", "cash", "portfolio_value", "layer").select(
        "account_id", "symbol", "allocation_pct", "size", (F.col("cash") / F.col("portfolio_value") * 100).alias("cash_pct"),
        F.when(layer == "thesis_structural", 1).when(layer == "thesis_tactical", 2).otherwise(3).alias("conviction"),
    )
    out = dc.drawdown_raise(held, "account_id", ["conviction", "size", "symbol"], "allocation_pct", "cash_pct")
    return out.select("account_id", "symbol", "cash_before", "close")


@query(
    "thesis_status",
    "PF-10",
    """SELECT l_partkey, CASE WHEN bool_or(l_tax >= 0.08 AND l_discount >= 0.1) THEN 'INVALIDATED' WHEN max(l_shipdate) <= DATE '2001-06-01' THEN
    'TIME EXPIRED' WHEN bool_or(l_discount > 0.09) THEN 'WEAKENING' WHEN bool_or(l_quantity >= 49) THEN 'STRENGTHENING' ELSE 'ACTIVE' END AS
    next_status FROM lineitem GROUP BY 1""",
)
def thesis_status(spark, sf):
    facts = b.table(spark, sf, "lineitem").select(
        "l_partkey",
        F.when(F.col("l_discount") > 0.09, "UNDER PRESSURE").otherwise("INTACT").alias("status"),
        (F.col("l_quantity") >= 49).alias("trigger_met"),
        ((F.col("l_tax") >= 0.08) & (F.col("l_discount") >= 0.1)).alias("kill"),
        F.col("l_shipdate").cast("date").alias("review_date"),
    )
    return dc.thesis_status(facts, "l_partkey", "2001-06-01")


_STREAK = """row_number() OVER (PARTITION BY entity_id ORDER BY month) - coalesce(max(CASE WHEN NOT {h} THEN r END) OVER (PARTITION BY entity_id
    ORDER BY month ROWS UNBOUNDED PRECEDING), 0)"""


@query(
    "divergence_verdict",
    "PF-11 WIN-8",
    compose(
        f"""SELECT *, CASE WHEN streak >= 7 OR streak >= 5 AND audit_failed THEN 'CHALLENGE' WHEN streak > 0 THEN 'CAUTION' ELSE 'AGREE' END AS verdict
        FROM (SELECT entity_id, CAST(month AS VARCHAR) AS month, fd AS family_divergence, sd AS score_divergence, ld AS liquidity_divergence,
        audit_failed, {_STREAK.format(h='fd')} AS streak FROM (SELECT *, coalesce(blind <> regime, false) AS fd, coalesce(NOT blind <> regime AND
        abs(growth_score - lag(growth_score) OVER e) > 0.3, false) AS sd, coalesce(liquidity_binary <> lag(liquidity_binary) OVER e, false) AS ld,
        abs(inflation_score) < 20 AS audit_failed, row_number() OVER e AS r FROM (SELECT *, CASE WHEN growth_score > 0.25 THEN
        'Goldilocks' ELSE regime_raw END AS blind FROM regimes) WINDOW e AS (PARTITION BY entity_id ORDER BY month)))""",
        "regimes",
    ),
)
def divergence_verdict(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("month")
    evals = regimes(spark, sf).select(
        "entity_id",
        "month",
        F.when(F.col("growth_score") > 0.25, "Goldilocks").otherwise(F.col("regime_raw")).alias("blind_family"),
        F.col("regime").alias("official_family"),
        F.col("growth_score").alias("blind_score"),
        F.lag("growth_score").over(w).alias("official_score"),
        F.col("liquidity_binary").alias("blind_liquidity"),
        F.lag("liquidity_binary").over(w).alias("official_liquidity"),
        (F.abs("inflation_score") < 20).alias("audit_failed"),
    )
    return dc.divergence_verdict(evals, ["entity_id"], "month").select(
        "entity_id", "month", "family_divergence", "score_divergence", "liquidity_divergence", "audit_failed", "streak", "verdict"
    )


SCAN_RULES = [
    ("capacity", "utilisation", ">", 80.0),
    ("inventory_days", "unrate", "<", 5.0),
    ("reserve", "reserve", "<", 400.0),
    ("refinery", "refinery", ">", 93.0),
    ("momentum", "momentum", ">", 15.0),
]


def _rule_sql(name: str, col: str, op: str, t: float) -> str:
    return f"""SELECT entity_id, '{name}' AS rule, {col}::DOUBLE AS value, coalesce({col} {op} {t}, false) AS flagged,
    coalesce(abs({col} / {t} - 1) <= 0.1, false) AS ambiguous FROM scan"""


cte(
    "scan",
    """SELECT entity_id, CASE WHEN rising THEN 80 + indpro_yoy END AS utilisation, unrate, 400 + m2_yoy AS reserve, 93 + retail_yoy / 10 AS refinery,
    fed_assets_yoy AS momentum FROM (SELECT *, indpro_yoy - lag(indpro_yoy, 8) OVER e > 0 AS rising, row_number() OVER (PARTITION BY entity_id
    ORDER BY month DESC) AS pos FROM wide WINDOW e AS (PARTITION BY entity_id ORDER BY month)) WHERE pos = 1""",
    "wide",
)


@query("scanner_flags", "PF-12 FLT-13", compose(" UNION ALL ".join(_rule_sql(*r) for r in SCAN_RULES), "scan"), "value")
def scanner_flags(spark, sf):
    rising = align.diff(F.col("indpro_yoy"), 8, ["entity_id"], "month") > 0
    wide = _wide(spark, sf).select("*", F.when(rising, F.col("indpro_yoy") + 80).alias("utilisation"))
    last = wide.groupBy("entity_id").agg(F.max_by(F.struct("utilisation", "unrate", "m2_yoy", "retail_yoy", "fed_assets_yoy"), "month").alias("s"))
    signals = last.select(
        "entity_id", "s.utilisation", "s.unrate", (F.col("s.m2_yoy") + 400).alias("reserve"),
        (F.col("s.retail_yoy") / 10 + 93).alias("refinery"), F.col("s.fed_assets_yoy").alias("momentum"),
    )
    return dc.scanner_flags(signals, SCAN_RULES, ["entity_id"])


@query(
    "capped_queue",
    "TOP-8",
    """SELECT p_brand, p_partkey, CASE WHEN rk <= 3 THEN rk ELSE 0 END AS rank, CASE WHEN rk <= 3 THEN 'advance' ELSE 'deferred' END AS decision
    FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size, p_partkey) AS rk FROM part)""",
)
def capped_queue(spark, sf):
    parts = b.table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    order = [F.col("p_retailprice").desc(), F.col("p_size"), F.col("p_partkey")]
    return dc.capped_queue(parts, "p_brand", "p_partkey", order, 3).select("p_brand", "p_partkey", "rank", "decision")


@query(
    "turnover_budget",
    "TOP-9",
    compose(
        """SELECT account_id, symbol, reserved, CASE WHEN reserved OR taken + coalesce(rest, 0) <= 25 THEN 'execute' ELSE 'skip' END AS decision FROM (
        SELECT *, coalesce(sum(CASE WHEN reserved THEN t END) OVER (PARTITION BY account_id), 0) AS taken, sum(CASE WHEN NOT reserved THEN t ELSE 0
        END) OVER (PARTITION BY account_id ORDER BY size, symbol ROWS UNBOUNDED PRECEDING) AS rest FROM (SELECT *, structural AND sum(t) OVER
        (PARTITION BY account_id, structural ORDER BY size, symbol ROWS UNBOUNDED PRECEDING) <= 5 AS reserved FROM (SELECT account_id, symbol,
        size, layer = 'thesis_structural' AS structural, allocation_pct AS t FROM positions)))""",
        "positions",
    ),
)
def turnover_budget(spark, sf):
    orders = b.positions(spark, sf, "account_id", "symbol", "size", "layer", "allocation_pct").select("account_id", "symbol", "size", "layer", F.col("allocation_pct").alias("turnover_pct"))
    out = dc.allocate_budget(orders, "account_id", ["size", "symbol"], F.col("layer") == "thesis_structural")
    return out.select("account_id", "symbol", "reserved", "decision")


cte(
    "tags",
    """SELECT n_name AS thesis_id, 'long' AS side, 'geography' AS tag_dim, r_name AS tag FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, 'reduce', 'sector', ['ECONOMY', 'STANDARD', 'MEDIUM', 'SMALL', 'LARGE', 'PROMO'][n_nationkey % 6 + 1] FROM nation""",
)


@query(
    "exposure_overlap",
    "JN-12",
    compose(
        """SELECT account_id, thesis_id, sum(CASE WHEN side = 'long' THEN p ELSE 0 END) AS overlap_pct, sum(CASE WHEN side = 'reduce' THEN p ELSE 0
        END) AS opposing_pct FROM (SELECT account_id, 'geography' AS tag_dim, geography AS tag, sum(allocation_pct) AS p FROM valued GROUP BY ALL
        UNION ALL SELECT account_id, 'sector', sector, sum(allocation_pct) FROM valued WHERE sector IS NOT NULL GROUP BY ALL) JOIN tags USING
        (tag_dim, tag) GROUP BY 1, 2""",
        "valued",
        "tags",
    ),
    "overlap_pct opposing_pct",
)
def exposure_overlap(spark, sf):
    n = b.table(spark, sf, "nation").join(b.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    types = F.array(*[F.lit(x) for x in _ETF])
    tag = lambda side, dim, value: F.struct(F.lit(side).alias("side"), F.lit(dim).alias("tag_dim"), value.alias("tag"))
    theses = n.select(
        F.col("n_name").alias("thesis_id"),
        F.inline(F.array(tag("long", "geography", F.col("r_name")), tag("reduce", "sector", types[F.col("n_nationkey") % 6]))),
    )
    return dc.exposure_overlap(pf.exposure(_valued(spark, sf, cols=_SPREAD)), theses)


cte(
    "forecasts",
    """SELECT r.entity_id, r.month AS made_on, 6 AS horizon, c.target, c.prob AS base_rate, 0.9 * c.prob + CASE WHEN c.target = r.regime THEN 0.1 ELSE
    0 END AS prob FROM regimes r JOIN counts4 c ON r.entity_id = c.entity_id AND r.regime = c.source AND c.horizon = 6 WHERE c.prob IS NOT NULL""",
    "regimes",
    "counts4",
)
cte(
    "resolved",
    """SELECT f.*, z.month AS target_month, z.regime AS outcome FROM forecasts f JOIN regimes z ON f.entity_id = z.entity_id AND
    z.month = last_day(f.made_on + INTERVAL 6 MONTH)""",
    "forecasts",
    "regimes",
)
cte(
    "brier",
    """SELECT entity_id, made_on, horizon, sum(power(prob - (target = outcome)::INT, 2)) AS adjusted_brier, sum(power(base_rate - (target =
    outcome)::INT, 2)) AS base_brier, avg(abs(prob - base_rate)) AS adjustment FROM resolved GROUP BY 1, 2, 3""",
    "resolved",
)


def _resolved(spark, sf):
    table = materialise(regimes(spark, sf).select("entity_id", "month", "regime"), "regimes")
    rates = tr.transition_counts(table, ["entity_id"], "month", "regime", L.FAMILIES, (6,)).where(F.col("prob").isNotNull())
    rates = rates.select("entity_id", "horizon", F.col("source").alias("regime"), "target", F.col("prob").alias("base_rate"))
    made = table.join(rates, ["entity_id", "regime"]).select(
        "entity_id",
        F.col("month").alias("made_on"),
        "horizon",
        "target",
        "base_rate",
        (F.col("base_rate") * 0.9 + F.when(F.col("target") == F.col("regime"), 0.1).otherwise(0.0)).alias("prob"),
    )
    return dc.resolve_forecasts(made, table)


@query(
    "resolved_forecasts",
    "JN-16",
    compose(
        """SELECT entity_id, CAST(made_on AS VARCHAR) AS made_on, CAST(target_month AS VARCHAR) AS target_month, CAST(horizon AS BIGINT) AS horizon,
        target, base_rate, prob, outcome FROM resolved""",
        "resolved",
    ),
    "base_rate prob",
)
def resolved_forecasts(spark, sf):
    return _resolved(spark, sf)


@query(
    "forecast_alpha",
    "AGG-24",
    compose(
        """SELECT entity_id, CAST(horizon AS BIGINT) AS horizon, n AS n_resolved, CASE WHEN n >= 20 THEN a END AS mean_alpha, adj AS mean_adjustment,
        streak AS negative_streak, n >= 20 AND streak >= 8 AS alert FROM (SELECT entity_id, horizon, count(*) AS n, avg(base_brier - adjusted_brier)
        AS a, avg(adjustment) AS adj, coalesce(min(CASE WHEN base_brier - adjusted_brier >= 0 THEN pos END), count(*) + 1) - 1 AS streak FROM
        (SELECT *, row_number() OVER (PARTITION BY entity_id, horizon ORDER BY made_on DESC) AS pos FROM brier) GROUP BY 1, 2)""",
        "brier",
    ),
    "mean_alpha mean_adjustment",
)
def forecast_alpha(spark, sf):
    return dc.forecast_alpha(dc.brier(_resolved(spark, sf)))


@query(
    "base_rates",
    "JN-17",
    compose(
        """SELECT entity_id, regime_8, CAST(horizon AS BIGINT) AS horizon, target, base_rate, matrix, mean_months FROM (SELECT l.entity_id,
        l.regime_8, s.horizon, s.target, s.shrunk AS base_rate, 'eight' AS matrix FROM latest l JOIN shrunk s ON l.entity_id = s.entity_id AND
        l.regime_8 = s.source WHERE s.shrunk IS NOT NULL UNION ALL SELECT l.entity_id, l.regime_8, c.horizon, c.target, c.prob, 'four' FROM latest l
        JOIN counts4 c ON l.entity_id = c.entity_id AND l.regime = c.source WHERE c.prob IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shrunk s WHERE
        s.entity_id = l.entity_id AND s.source = l.regime_8 AND s.shrunk IS NOT NULL)) LEFT JOIN (SELECT entity_id, label AS regime_8, avg(length)
        AS mean_months FROM runs8 GROUP BY 1, 2) USING (entity_id, regime_8)""",
        "latest",
        "shrunk",
        "counts4",
        "runs8",
    ),
    "base_rate mean_months",
)
def base_rates(spark, sf):
    table = materialise(regimes(spark, sf), "regimes")
    current = regime.latest(table.select("entity_id", "month", "regime_raw", "regime", "regime_8")).select("entity_id", "regime", "regime_8")
    durations = tr.duration_stats(table, ["entity_id"], "month", "regime_8")
    return dc.base_rates(current, shrunk(spark, sf, table), counts4(spark, sf, table), durations)


@query(
    "trailing_majority",
    "WIN-21",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, vote, last_value(CASE WHEN nl * 2 > 4 THEN 'loose' WHEN nt * 2 > 4 THEN 'tight' END IGNORE
        NULLS) OVER (PARTITION BY entity_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS condition FROM (SELECT *, count(*) FILTER (vote = 'loose') OVER
        q AS nl, count(*) FILTER (vote = 'tight') OVER q AS nt FROM (SELECT entity_id, month, CASE WHEN up > down THEN 'loose' WHEN down > up THEN
        'tight' END AS vote FROM (SELECT entity_id, month, coalesce((l_m2 = 1)::INT, 0) + coalesce((l_nfci = 1)::INT, 0) + coalesce((l_fed =
        1)::INT, 0) AS up, coalesce((l_m2 = 0)::INT, 0) + coalesce((l_nfci = 0)::INT, 0) + coalesce((l_fed = 0)::INT, 0) AS down FROM votes))
        WINDOW q AS (PARTITION BY entity_id ORDER BY month ROWS 3 PRECEDING))""",
        "votes",
    ),
)
def trailing_majority(spark, sf):
    votes = _wide(spark, sf).select("entity_id", "month", *[regime.liquidity_vote(c, i).alias(f"v_{c}") for c, i in regime.LIQUIDITY])
    return dc.trailing_majority(votes, ["entity_id"], "month", [f"v_{c}" for c, _ in regime.LIQUIDITY])


@query(
    "lead_time",
    "WIN-22",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, changed, diverged, CASE WHEN changed THEN (r - first_div)::DOUBLE END AS lead, diverged AND
        coalesce(ahead, false) AS hit, CASE WHEN diverged THEN CASE WHEN coalesce(around, false) THEN 'transition' ELSE 'stable' END END AS context
        FROM (SELECT *, min(CASE WHEN diverged THEN r END) OVER (PARTITION BY entity_id, epoch ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1
        PRECEDING) AS first_div FROM (SELECT *, coalesce(max(CASE WHEN changed THEN r END) OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch, bool_or(changed) OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN 1 FOLLOWING AND
        4 FOLLOWING) AS ahead, bool_or(changed) OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS around
        FROM (SELECT entity_id, month, regime_raw <> regime AS diverged, coalesce(regime <> lag(regime) OVER e, false) AS changed, row_number() OVER
        e AS r FROM regimes WINDOW e AS (PARTITION BY entity_id ORDER BY month)))) WHERE changed OR diverged""",
        "regimes",
    ),
    "lead",
)
def lead_time(spark, sf):
    evals = regimes(spark, sf).select(
        "entity_id", "month", F.col("regime").alias("official"), (F.col("regime_raw") != F.col("regime")).alias("diverged")
    )
    return dc.lead_time(evals, ["entity_id"], "month")


@query(
    "quality_trend",
    "WIN-24",
    compose(
        """SELECT account_id, week, n_events, coalesce(n_events < p1 AND p1 < p2, false) AS degrading FROM (SELECT *, lag(n_events) OVER a AS p1,
        lag(n_events, 2) OVER a AS p2 FROM weekly_history WINDOW a AS (PARTITION BY account_id ORDER BY week))""",
        "weekly_history",
    ),
)
def quality_trend(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("account_id").orderBy("week")
    n, one, two = F.col("n_events"), F.lag("n_events").over(w), F.lag("n_events", 2).over(w)
    return b.weekly_history(spark, sf).select(
        "account_id", "week", "n_events", F.coalesce((n < one) & (one < two), F.lit(False)).alias("degrading")
    )


@query(
    "theme_persistence",
    "WIN-25",
    """SELECT account_id, event_type, weeks_running, last_week, weeks_running >= 3 AS persistent FROM (SELECT account_id, event_type, count(*) AS
    weeks_running, max(w) AS last_week FROM (SELECT *, w - row_number() OVER (PARTITION BY account_id, event_type ORDER BY w) AS i FROM (SELECT
    DISTINCT CAST(user_id AS VARCHAR) AS account_id, event_type, CAST(date_diff('day', DATE '1970-01-05', CAST(ts AS DATE)) // 7 AS BIGINT) AS w
    FROM events)) GROUP BY account_id, event_type, i QUALIFY row_number() OVER (PARTITION BY account_id, event_type ORDER BY max(w) DESC) = 1)""",
)
def theme_persistence(spark, sf):
    from tidemark.functions import dates

    mentions = b.events(spark, sf).select("account_id", "event_type", dates.week_index(F.col("day")).alias("week_no"))
    return dc.theme_persistence(mentions, ["account_id", "event_type"])


@query(
    "trailing_shares",
    "AGG-23",
    compose(
        """SELECT account_id, week, avg(diverged::INT) OVER (PARTITION BY account_id ORDER BY week ROWS 7 PRECEDING) AS divergence_share,
        avg(liquidity_diverged::INT) OVER (PARTITION BY account_id ORDER BY week ROWS 11 PRECEDING) AS challenge_share FROM weekly_history""",
        "weekly_history",
    ),
    "divergence_share challenge_share",
)
def trailing_shares(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("account_id").orderBy("week")
    share = lambda c, n: F.avg(F.col(c).cast("double")).over(w.rowsBetween(-(n - 1), 0))
    return b.weekly_history(spark, sf).select(
        "account_id", "week", share("diverged", 8).alias("divergence_share"), share("liquidity_diverged", 12).alias("challenge_share")
    )


@query(
    "coverage",
    "AGG-41",
    compose(
        """SELECT account_id, useful, attempted, useful / attempted AS hit_ratio, useful / attempted < 0.5 AS broken, gap_streak, gap_streak >= 3 AS
        systematic FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, count(*) FILTER (event_type IN ('view', 'purchase')) AS useful, count(*) AS
        attempted FROM events GROUP BY 1) JOIN (SELECT account_id, CAST(coalesce(min(CASE WHEN NOT diverged THEN pos END), count(*) + 1) - 1 AS BIGINT)
        AS gap_streak FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY week DESC) AS pos FROM weekly_history) GROUP BY 1) USING
        (account_id)""",
        "weekly_history",
    ),
    "hit_ratio",
)
def coverage(spark, sf):
    useful = F.count(F.when(F.col("event_type").isin("view", "purchase"), 1))
    hits = b.events(spark, sf).groupBy("account_id").agg(useful.alias("useful"), F.count("*").alias("attempted"))
    gaps = tr.trailing_streak(b.weekly_history(spark, sf), ["account_id"], "week", {"gap_streak": F.col("diverged")})
    ratio = F.col("useful") / F.col("attempted")
    return hits.join(gaps, "account_id").select(
        "account_id", "useful", "attempted", ratio.alias("hit_ratio"), (ratio < 0.5).alias("broken"), "gap_streak", (F.col("gap_streak") >= 3).alias("systematic")
    )


@query(
    "theme_convergence",
    "AGG-44",
    """SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, props AS theme, count(DISTINCT user_id) AS n_sources FROM events
    GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3""",
)
def theme_convergence(spark, sf):
    from tidemark.functions import dates

    mentions = b.events(spark, sf).select(dates.iso_week(F.col("day")).alias("week"), F.col("props").alias("theme"), "account_id")
    return dc.theme_convergence(mentions, ["week", "theme"], "account_id")


@query(
    "scorecard",
    "AGG-45",
    """SELECT event_type, week, correct, partial, wrong, too_early, CASE WHEN sum(correct + partial + wrong) OVER c > 0 THEN sum(correct) OVER c /
    sum(correct + partial + wrong) OVER c * 100 END AS cumulative_rate FROM (SELECT event_type, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR),
    2, '0') AS week, count(*) FILTER (value >= 60) AS correct, count(*) FILTER (value >= 30 AND value < 60) AS partial, count(*) FILTER (value >= 5 AND
    value < 30) AS wrong, count(*) FILTER (value < 5) AS too_early FROM events GROUP BY 1, 2) WINDOW c AS (PARTITION BY event_type ORDER BY week ROWS
    UNBOUNDED PRECEDING)""",
    "cumulative_rate",
)
def scorecard(spark, sf):
    from tidemark.functions import dates

    v = F.col("value")
    verdict = F.when(v >= 60, "CORRECT").when(v >= 30, "PARTIAL").when(v >= 5, "WRONG").otherwise("TOO EARLY")
    calls = b.events(spark, sf).select("event_type", dates.iso_week(F.col("day")).alias("week"), verdict.alias("verdict"))
    return dc.scorecard(calls, "event_type", "week")


@query(
    "funnel_health",
    "AGG-46",
    """SELECT source, n, n / sum(n) OVER () AS provenance_share, n / sum(n) OVER () > 0.6 AS dominant, empty_share, survival_share, conversion FROM (
    SELECT source, count(*) AS n, avg((quality IS NULL)::INT) AS empty_share, avg(quality) AS survival_share, avg((quality = 1 AND
    toxic = 0)::INT) AS conversion FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)""",
    "provenance_share empty_share survival_share conversion",
)
def funnel_health(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "source").join(b.table(spark, sf, "labels"), "doc_id", "left")
    per = docs.groupBy("source").agg(
        F.count("*").alias("n"),
        F.avg(F.col("quality").isNull().cast("double")).alias("empty_share"),
        F.avg("quality").alias("survival_share"),
        F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")).alias("conversion"),
    )
    total = docs.agg(F.count("*").alias("_t"))
    # One-row total, so the join is a scalar lookup.
    share = F.col("n") / F.col("_t")
    return per.join(F.broadcast(total)).select(
        "source", "n", share.alias("provenance_share"), (share > 0.6).alias("dominant"), "empty_share", "survival_share", "conversion"
    )


@query(
    "changed_attributes",
    "JN-15",
    """SELECT account_id, field, old, new FROM (SELECT account_id, unnest([{'field': 'event_type', 'old': o.event_type, 'new': n.event_type, 'c': o.event_type
    IS DISTINCT FROM n.event_type}, {'field': 'n_events', 'old': CAST(o.n AS VARCHAR), 'new': CAST(n.n AS VARCHAR), 'c': o.n IS DISTINCT FROM n.n}],
    recursive := true) FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type FROM events
    WHERE ts < DATE '2024-01-15' GROUP BY 1) o FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS account_id, count(*) AS n, arg_max(event_type, (ts,
    event_id)) AS event_type FROM events WHERE ts >= DATE '2024-01-15' GROUP BY 1) n USING (account_id)) WHERE c""",
)
def changed_attributes(spark, sf):
    ev = b.events(spark, sf)
    cut = F.lit("2024-01-15").cast("date")
    version = lambda rows: rows.groupBy("account_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.count("*").alias("n_events")
    )
    return dc.snapshot_diff(version(ev.where(F.col("day") < cut)), version(ev.where(F.col("day") >= cut)), ["account_id"], ["event_type", "n_events"])
