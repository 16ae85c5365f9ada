"""Registered queries: similarity, analog signals and their back-test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.functions.resample import BITS, random_bits_sql
from tidemark.functions.thresholds import threshold_sql
from tidemark.operators import align, analogs as an
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.decision_queries import _ETF, _ETF_SQL
from tidemark.plans.registry import query
from tidemark.session import materialise

_LAGGED = ", ".join(f"lag({c}, {n}) OVER e AS {c}" if n else c for c, n in align.RELEASE_LAG.items())
cte("lagged", f"SELECT entity_id, month, {_LAGGED} FROM spine WINDOW e AS (PARTITION BY entity_id ORDER BY month)", "spine")


def _raw(c: str, kind: str, sign: int) -> str:
    s = "-" if sign < 0 else ""
    if kind == "change":
        return f"{s}({c} - lag({c}, 6) OVER e) AS {c}"
    frame = "OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN 35 PRECEDING AND CURRENT ROW)"
    return f"{s}({c} - CASE WHEN count({c}) {frame} >= 12 THEN quantile_cont({c}, 0.5) {frame} END) AS {c}"


cte(
    "raw_features",
    "SELECT entity_id, month, " + ", ".join(_raw(*f) for f in an.FEATURES) + " FROM lagged WINDOW e AS (PARTITION BY entity_id ORDER BY month)",
    "lagged",
)
_RANKS = ", ".join(
    f"(CASE WHEN a.{c} IS NULL THEN NULL WHEN count(z.{c}) > 1 THEN (count(*) FILTER (z.{c} <= a.{c}) - 1)::DOUBLE / (count(z.{c}) - 1) ELSE 0.5 END - 0.5) * 2 AS {c}"
    for c, _, _ in an.FEATURES
)
cte(
    "states",
    f"""SELECT entity_id, month, [{', '.join(c for c, _, _ in an.FEATURES)}] AS state FROM (SELECT a.entity_id, a.month, {_RANKS}
    FROM raw_features a JOIN raw_features z ON a.entity_id = z.entity_id AND z.month <= a.month GROUP BY a.entity_id, a.month,
    {', '.join('a.' + c for c, _, _ in an.FEATURES)}) WHERE {' AND '.join(c + ' IS NOT NULL' for c, _, _ in an.FEATURES)}""",
    "raw_features",
)
cte(
    "asked",
    """SELECT * FROM (SELECT *, lag(month) OVER e - INTERVAL 12 MONTH AS cutoff, row_number() OVER e - 1 AS n_train FROM states
    WINDOW e AS (PARTITION BY entity_id ORDER BY month)) WHERE n_train >= 20""",
    "states",
)
cte(
    "pairs_ranked",
    """SELECT q.entity_id, q.month, h.month AS analog_month, list_cosine_similarity(q.state, h.state) AS sim, count(*) OVER (PARTITION BY
    q.entity_id, q.month) AS n_candidates, row_number() OVER (PARTITION BY q.entity_id, q.month ORDER BY list_cosine_similarity(q.state, h.state)
    DESC, h.month) AS rank FROM asked q JOIN states h ON q.entity_id = h.entity_id AND h.month <= q.cutoff""",
    "asked",
    "states",
)
cte("analogs", "SELECT * FROM pairs_ranked WHERE rank <= 20 AND n_candidates >= 10", "pairs_ranked")
cte(
    "eweekly",
    """SELECT entity_id, asset_id, week, arg_max(close, price_date) AS close FROM (SELECT *, CAST(price_date + CAST((12 - isodow(price_date))
    % 7 AS INTEGER) AS DATE) AS week FROM eprices) GROUP BY 1, 2, 3""",
    "eprices",
)
cte(
    "weekly_fwd",
    " UNION ALL ".join(
        f"""SELECT entity_id, asset_id, week, {n} AS "window", CASE WHEN close > 0 THEN (lead(close, {n}) OVER a / close - 1) * 100 END AS ret
        FROM eweekly WINDOW a AS (PARTITION BY entity_id, asset_id ORDER BY week)"""
        for n in an.FORWARD_WEEKS
    ),
    "eweekly",
)
cte(
    "month_returns",
    """SELECT m.entity_id, m.asset_id, m.month, f."window", f.ret FROM (SELECT s.entity_id, s.month, w.asset_id, w.week, row_number() OVER
    (PARTITION BY s.entity_id, s.month, w.asset_id ORDER BY abs(date_diff('day', w.week, s.month)), w.week DESC) AS rn FROM states s JOIN eweekly w
    ON s.entity_id = w.entity_id AND w.week BETWEEN s.month - 14 AND s.month + 14) m JOIN weekly_fwd f ON m.entity_id = f.entity_id AND
    m.asset_id = f.asset_id AND m.week = f.week WHERE m.rn = 1""",
    "states",
    "eweekly",
    "weekly_fwd",
)
cte(
    "analog_returns",
    """SELECT a.entity_id, a.month, r.asset_id, r."window", r.ret FROM analogs a JOIN month_returns r ON a.entity_id = r.entity_id AND
    a.analog_month = r.month WHERE r.ret IS NOT NULL""",
    "analogs",
    "month_returns",
)
cte(
    "risk_reward",
    f"""SELECT *, coalesce({threshold_sql('ratio', 'ratio')}, 'insufficient_data') AS signal FROM (SELECT entity_id, month, asset_id, "window", n,
    CASE WHEN n >= 3 THEN CASE WHEN abs(down) < 0.1 AND up < 0.1 THEN 1.0 WHEN abs(down) < 0.1 THEN least(10.0, up / 0.1) WHEN up < 0.1 THEN
    greatest(0.1, 0.1 / abs(down)) ELSE least(10.0, greatest(0.1, up / abs(down))) END END AS ratio, CASE WHEN n >= 3 THEN up END AS mean_upside,
    CASE WHEN n >= 3 THEN down END AS mean_downside, CASE WHEN n >= 3 THEN hit END AS hit_rate, CASE WHEN n >= 3 THEN m END AS mean, CASE WHEN
    n >= 3 THEN md END AS median, CASE WHEN n >= 3 THEN sd END AS std, CASE WHEN n >= 20 THEN 'high' WHEN n >= 10 THEN 'medium' WHEN n >= 5 THEN
    'low' ELSE 'insufficient_data' END AS confidence FROM (SELECT entity_id, month, asset_id, "window", count(*) AS n, coalesce(avg(w) FILTER
    (w > 0), 0.0) AS up, coalesce(avg(w) FILTER (w < 0), 0.0) AS down, count(*) FILTER (ret > 0) * 100.0::DOUBLE / count(*) AS hit, avg(ret) AS m,
    quantile_cont(ret, 0.5) AS md, stddev_pop(ret) AS sd FROM (SELECT *, greatest(lo, least(hi, ret)) AS w FROM analog_returns JOIN (SELECT
    entity_id, month, asset_id, "window", quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM analog_returns GROUP BY 1, 2, 3, 4)
    USING (entity_id, month, asset_id, "window")) GROUP BY 1, 2, 3, 4))""",
    "analog_returns",
)
cte(
    "preds",
    """SELECT s.*, r.ret AS actual FROM risk_reward s JOIN month_returns r USING (entity_id, month, asset_id, "window") WHERE r.ret IS NOT NULL""",
    "risk_reward",
    "month_returns",
)
_HIT = """CASE WHEN contains(signal, 'bullish') THEN (abs(actual) >= 0.5 AND actual > 0)::INT WHEN contains(signal, 'bearish') THEN (abs(actual)
    >= 0.5 AND actual < 0)::INT END"""


def _states(spark, sf):
    wide = align.align_on_spine(align.to_indicators(align.resample_last(b.observations(spark, sf))), require=None)
    return an.state_vectors(wide)


def _weekly(spark, sf):
    return align.resample_last(b.entity_prices(spark, sf), ["entity_id", "asset_id"], "week", "price_date", "close", "week")


def _month_returns(spark, sf, states):
    return an.returns_at_months(_weekly(spark, sf), states.select("entity_id", "month"))


def _signals(spark, sf):
    states = materialise(_states(spark, sf), "states")
    rets = materialise(_month_returns(spark, sf, states), "month-returns")
    found = an.find_analogs(states).select("entity_id", F.col("month").alias("query_month"), F.col("analog_month").alias("month"))
    pairs = found.join(rets, ["entity_id", "month"]).drop("month").withColumnRenamed("query_month", "month")
    return an.risk_reward(pairs, ["entity_id", "month", "asset_id", "window"]), rets, states


@query(
    "state_vectors",
    "SC-14 WIN-4 WIN-5",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, list_sum(state[1:4]) / 4 AS growth, list_sum(state[5:6]) / 2 AS inflation,
        list_sum(state[7:9]) / 3 AS liquidity, list_sum(list_transform(state, lambda x: x * x)) AS energy FROM states""",
        "states",
    ),
    "growth inflation liquidity energy",
)
def state_vectors(spark, sf):
    s = F.col("state")
    return _states(spark, sf).select(
        "entity_id", "month", *[vectors.composite(s, *an.GROUPS[g]).alias(g) for g in an.GROUPS], vectors.dot(s, s).alias("energy")
    )


@query(
    "expanding_rank_long_keys",
    "WIN-4",
    compose(
        """SELECT a.entity_id, CAST(a.month AS VARCHAR) AS month, CASE WHEN count(*) > 1 THEN CAST(count(*) FILTER (WHERE z.cpi_yoy <= a.cpi_yoy) - 1
        AS DOUBLE) / (count(*) - 1) ELSE 0.5 END AS rank_pct FROM wide a JOIN wide z ON a.entity_id = z.entity_id AND z.month <= a.month
        GROUP BY a.entity_id, a.month""",
        "wide",
    ),
    "rank_pct",
)
def expanding_rank_long_keys(spark, sf):
    from tidemark.plans.panel_queries import _wide

    return align.expanding_rank(_wide(spark, sf), ["entity_id"], ["month"], "cpi_yoy", "rank_pct").drop("cpi_yoy")


@query(
    "expanding_rank_prices",
    "WIN-4",
    """SELECT a.segment, a.o_orderkey, CASE WHEN count(*) > 1 THEN CAST(count(*) FILTER (WHERE z.v <= a.v) - 1 AS DOUBLE) / (count(*) - 1) ELSE 0.5 END AS
    rank_pct FROM (SELECT o_orderpriority AS segment, o_orderkey, o_totalprice AS v FROM orders) a JOIN (SELECT o_orderpriority AS segment, o_orderkey,
    o_totalprice AS v FROM orders) z ON a.segment = z.segment AND z.o_orderkey <= a.o_orderkey GROUP BY a.segment, a.o_orderkey""",
    "rank_pct",
)
def expanding_rank_prices(spark, sf):
    """Five keys that hold a fifth of all orders each."""
    orders = b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("segment"), "o_orderkey", "o_totalprice")
    return align.expanding_rank(orders, ["segment"], ["o_orderkey"], "o_totalprice", "rank_pct", block=256).drop("o_totalprice")


@query(
    "analogs",
    "TOP-1 JN-9",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, CAST(analog_month AS VARCHAR) AS analog_month, sim, rank FROM analogs""", "analogs"
    ),
    "sim",
)
def analogs(spark, sf):
    return an.find_analogs(materialise(_states(spark, sf), "states"))


@query(
    "similar_vectors",
    "TOP-1 SC-13",
    """SELECT q.vec_id AS q_id, h.vec_id AS h_id, list_cosine_similarity(q.v, h.v) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY
    list_cosine_similarity(q.v, h.v) DESC, h.vec_id) AS rank FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) q JOIN (SELECT vec_id,
    embedding::DOUBLE[] AS v FROM embeddings) h ON h.vec_id < q.vec_id QUALIFY rank <= 20""",
    "sim",
)
def similar_vectors(spark, sf):
    vec = b.table(spark, sf, "embeddings").select(
        F.when(F.col("vec_id").isNotNull(), "all").alias("universe"), "vec_id", F.col("embedding").alias("v")
    )
    queries = vec.select("universe", F.col("vec_id").alias("q_id"), F.col("v").alias("q_vec"), (F.col("vec_id") - 1).alias("cutoff"))
    history = vec.select("universe", F.col("vec_id").alias("h_id"), F.col("vec_id").alias("h_ord"), F.col("v").alias("h_vec"))
    return an.top_k_similar(queries, history, ["universe"], block=128).select("q_id", "h_id", "sim", "rank")


@query(
    "consecutive_cosine",
    "SC-13",
    """SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], prev) AS sim FROM (SELECT *, lag(embedding::DOUBLE[]) OVER (PARTITION BY label
    ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL""",
    "sim",
)
def consecutive_cosine(spark, sf):
    from tidemark.operators.scans import running

    vec = b.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    pairs = running(vec, ["label"], [F.col("vec_id")], F.floor(F.col("vec_id") / 10000), {"prev": ("prev", F.col("v"))})
    return pairs.where(F.col("prev").isNotNull()).select("vec_id", vectors.cosine(F.col("v"), F.col("prev")).alias("sim"))


_SIGNAL_COLS = "ratio mean_upside mean_downside hit_rate mean median std"


@query(
    "analog_signals",
    "AGG-14 AGG-15 SC-15",
    compose(
        f"""SELECT entity_id, CAST(month AS VARCHAR) AS month, asset_id, CAST("window" AS BIGINT) AS "window", n, {_SIGNAL_COLS.replace(' ', ', ')},
        confidence, signal FROM risk_reward""",
        "risk_reward",
    ),
    _SIGNAL_COLS,
)
def analog_signals(spark, sf):
    return _signals(spark, sf)[0]


def _preds(spark, sf):
    signals, rets, _ = _signals(spark, sf)
    return an.predictions(signals, rets)


@query(
    "direction_accuracy",
    "AGG-16",
    compose(
        f"""SELECT entity_id, count(h) AS directional, CAST(coalesce(sum(h), 0) AS BIGINT) AS correct, avg(h) * 100 AS hit_rate, count(*) FILTER (signal =
        'neutral') AS neutral, count(*) FILTER (signal = 'neutral' AND abs(actual) < 0.5) AS neutral_correct FROM (SELECT *, {_HIT} AS h FROM preds)
        GROUP BY 1""",
        "preds",
    ),
    "hit_rate",
)
def direction_accuracy(spark, sf):
    return an.direction_accuracy(_preds(spark, sf), ["entity_id"])


@query(
    "naive_baseline",
    "AGG-17",
    compose(
        f"""SELECT *, greatest(positive_rate, 100 - positive_rate) AS naive, model_hit_rate - greatest(positive_rate, 100 - positive_rate) AS excess FROM
        (SELECT entity_id, asset_id, CAST("window" AS BIGINT) AS "window", count(*) AS n, count(h) AS n_predictions, avg(h) * 100 AS model_hit_rate,
        avg((actual > 0.5)::INT) * 100 AS positive_rate, avg(contains(signal, 'bullish')::INT) * 100 AS bullish_pct FROM (SELECT *, {_HIT} AS h FROM
        preds) GROUP BY 1, 2, 3) WHERE n >= 5""",
        "preds",
    ),
    "model_hit_rate positive_rate bullish_pct naive excess",
)
def naive_baseline(spark, sf):
    return an.naive_baseline(_preds(spark, sf), ["entity_id", "asset_id", "window"])


_BITS = random_bits_sql("42", "b", "entity_id", "asset_id", "month", '"window"')
_WEIGHT = " + ".join(f"(u > {step * 2**BITS})::INT" for step in an.POISSON_STEPS)


@query(
    "hit_rate_interval",
    "AGG-19",
    compose(
        f"""SELECT entity_id, n, hit_rate, ci_low * 100 AS ci_low, ci_high * 100 AS ci_high FROM (SELECT entity_id, count(*) AS n, avg(h) * 100 AS hit_rate FROM
        (SELECT entity_id, {_HIT} AS h FROM preds) WHERE h IS NOT NULL GROUP BY 1) JOIN (SELECT entity_id, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS
        ci_high FROM (SELECT entity_id, b, CASE WHEN sum(w) > 0 THEN sum(w * h) / sum(w) END AS r FROM (SELECT entity_id, b, h, {_WEIGHT} AS w FROM (SELECT entity_id, b, h,
        {_BITS} AS u FROM (SELECT *, unnest(range(1, 1001)) AS b FROM (SELECT *, {_HIT} AS h FROM preds) WHERE h IS NOT NULL))) GROUP BY 1, 2) GROUP BY 1) USING
        (entity_id)""",
        "preds",
    ),
    "hit_rate ci_low ci_high",
)
def hit_rate_interval(spark, sf):
    preds = _preds(spark, sf).select(
        "entity_id", "asset_id", "month", "window", an.outcome(F.col("signal"), F.col("actual")).alias("hit")
    )
    return an.bootstrap_proportion(preds.where(F.col("hit").isNotNull()), ["entity_id"], ["asset_id", "month", "window"])


@query(
    "surprises",
    "SC-16",
    compose(
        f"""SELECT entity_id, CAST(month AS VARCHAR) AS month, asset_id, symbol, CAST("window" AS BIGINT) AS "window", signal, axis, way FROM (SELECT *,
        {_ETF_SQL.replace('p_type', 'asset_id')} AS symbol, CASE WHEN list_sum(state[1:4]) > 0 THEN 'rising' ELSE 'falling' END AS growth,
        CASE WHEN list_sum(state[5:6]) > 0 THEN 'rising' ELSE 'falling' END AS inflation, CASE WHEN list_sum(state[7:9]) > 0 THEN 'ample' ELSE 'tight'
        END AS liquidity FROM risk_reward JOIN states USING (entity_id, month) WHERE contains(signal, 'bullish')) JOIN (VALUES
        ('growth', 'falling', 'SPY'), ('growth', 'falling', 'QQQ'), ('growth', 'falling', 'IWM'), ('growth', 'rising', 'TLT'), ('growth', 'rising', 'GLD'),
        ('inflation', 'falling', 'GSG'), ('liquidity', 'tight', 'HYG'), ('liquidity', 'tight', 'SPY'), ('liquidity', 'tight', 'QQQ'),
        ('liquidity', 'tight', 'IWM'), ('liquidity', 'ample', 'GLD'), ('liquidity', 'ample', 'SHV')) r(axis, way, symbol) USING (symbol)
        WHERE way = CASE axis WHEN 'growth' THEN growth WHEN 'inflation' THEN inflation ELSE liquidity END""",
        "risk_reward",
        "states",
    ),
)
def surprises(spark, sf):
    signals, _, states = _signals(spark, sf)
    names = F.create_map(*[F.lit(x) for item in _ETF.items() for x in item])
    return an.surprises(signals, states, names[F.col("asset_id")])
