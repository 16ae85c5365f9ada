"""Registered queries: selection, freshness, completeness, contracts, schema rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import align, quality as ql, regime, signals as sg
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose
from tidemark.plans.panel_queries import regimes
from tidemark.plans.registry import query
from tidemark.session import materialise
from tidemark.plans.transition_queries import shrunk

AS_OF = "2001-06-30"
LAST_MONTH = "2001-10-31"
EVENTS_AS_OF = "2024-01-30 12:00:00"
SERIES_IDS = list(align.INDICATORS)
#: Bindings of the series to frequencies and categories.
SLOW = ("RSAFS", "PAYEMS")
CATEGORY = {
    "INDPRO": "growth", "UNRATE": "employment", "RSAFS": "growth", "PAYEMS": "employment", "CPIAUCSL": "inflation",
    "CPILFESL": "inflation", "M2SL": "money_supply", "NFCI": "financial_conditions", "WALCL": "equities",
}


@query(
    "frequency_lookback",
    "FLT-1",
    compose(
        f"""SELECT entity_id, series_id, CAST(obs_date AS VARCHAR) AS obs_date, value FROM obs WHERE obs_date <= DATE '{AS_OF}'
        AND obs_date >= DATE '{AS_OF}' - CASE WHEN series_id IN ('M2SL', 'NFCI', 'WALCL') THEN 1825 WHEN series_id IN
        ('RSAFS', 'PAYEMS') THEN 400 ELSE 182 END""",
        "obs",
    ),
    "value",
)
def frequency_lookback(spark, sf):
    series = F.col("series_id")
    days = ql.frequency_days(F.when(series.isin(*SLOW), "monthly").otherwise("weekly"), series.isin("M2SL", "NFCI", "WALCL"))
    return ql.lookback(b.observations(spark, sf), AS_OF, days)


@query(
    "selected_series",
    "FLT-2",
    compose(
        """SELECT entity_id, series_id, CAST(obs_date AS VARCHAR) AS obs_date, value FROM obs
        WHERE series_id IN ('INDPRO', 'PAYEMS')""",
        "obs",
    ),
    "value",
)
def selected_series(spark, sf):
    return ql.select_series(b.observations(spark, sf), ["INDPRO", "PAYEMS"])


def _cards(spark, sf):
    return sg.latest_and_prior(b.observations(spark, sf)).select("entity_id", "series_id", "latest_value")


@query(
    "anomalies_excluded",
    "FLT-4",
    compose(
        "SELECT entity_id, series_id, latest_value FROM cards ANTI JOIN anomalies USING (entity_id, series_id)",
        "cards",
        "anomalies",
    ),
    "latest_value",
)
def anomalies_excluded(spark, sf):
    cards = materialise(_cards(spark, sf), "cards")
    return ql.exclude(cards, sg.range_anomalies(cards), ["entity_id", "series_id"])


_CATS = ", ".join(f"('{s}', '{c}')" for s, c in CATEGORY.items())


@query(
    "macro_categories",
    "FLT-5",
    compose(
        f"""SELECT entity_id, series_id, latest_value FROM cards SEMI JOIN (SELECT * FROM (VALUES {_CATS}) m(series_id, category)
        WHERE category IN ('growth', 'inflation', 'money_supply')) USING (series_id)""",
        "cards",
    ),
    "latest_value",
)
def macro_categories(spark, sf):
    meta = spark.createDataFrame(list(CATEGORY.items()), "series_id STRING, category STRING")
    return ql.keep_categories(_cards(spark, sf), meta, ["growth", "inflation", "money_supply"])


@query(
    "freshness",
    "FLT-6",
    f"""SELECT *, age_hours > 18 AS failed, age_hours > 120 AS warned, CASE WHEN age_hours > 168 THEN 'STALE' ELSE 'FRESH'
    END AS status FROM (SELECT CAST(user_id AS VARCHAR) AS account_id, CAST(trunc(date_diff('microsecond', max(ts), TIMESTAMP
    '{EVENTS_AS_OF}') / 3600000000) AS BIGINT) AS age_hours FROM events GROUP BY 1)""",
)
def freshness(spark, sf):
    return ql.freshness(b.events(spark, sf), ["account_id"], "ts", EVENTS_AS_OF)


@query(
    "missing_required_keys",
    "FLT-7 SET-3",
    compose(
        f"""SELECT entity_id, series_id FROM (SELECT DISTINCT entity_id, s.series_id FROM obs, (VALUES
        {', '.join(f"('{s}')" for s in SERIES_IDS)}) s(series_id)) ANTI JOIN (SELECT * FROM monthly WHERE month =
        DATE '{LAST_MONTH}') USING (entity_id, series_id)""",
        "obs",
        "monthly",
    ),
)
def missing_required_keys(spark, sf):
    monthly = materialise(align.resample_last(b.observations(spark, sf)), "monthly")
    required = monthly.select("entity_id").distinct().select(
        "entity_id", F.explode(F.array(*[F.lit(s) for s in SERIES_IDS])).alias("series_id")
    )
    return ql.missing_keys(required, monthly.where(F.col("month") == F.lit(LAST_MONTH).cast("date")), ["entity_id", "series_id"], "value")


@query(
    "contract_gaps",
    "FLT-8",
    """SELECT w.account_id || '/' || w.week || '/' || t.kind AS name, w.account_id AS account_id, w.week AS week FROM (
    SELECT DISTINCT CAST(user_id AS VARCHAR) AS account_id, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0')
    AS week FROM events) w, (VALUES ('view', 0), ('click', 0), ('purchase', 1)) t(kind, conditional) WHERE (conditional = 0
    OR w.account_id IN (SELECT CAST(user_id AS VARCHAR) FROM events GROUP BY 1 HAVING max(CAST(ts AS DATE)) =
    DATE '2024-01-30')) AND w.account_id || '/' || w.week || '/' || t.kind NOT IN (SELECT user_id || '/' || isoyear(ts) ||
    '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') || '/' || event_type FROM events)""",
)
def contract_gaps(spark, sf):
    ev = b.events(spark, sf).select("account_id", dates.iso_week(F.col("day")).alias("week"), "event_type", "day")
    runs = ev.groupBy("account_id", "week").agg(F.max("day").alias("_d"))
    tracker = ev.groupBy("account_id").agg((F.max("day") == F.lit("2024-01-30").cast("date")).alias("ran_today"))
    contract = F.array(
        *[F.struct(F.lit(f"{{account}}/{{week}}/{k}").alias("pattern"), F.lit(c).alias("conditional")) for k, c in (("view", False), ("click", False), ("purchase", True))]
    )
    expected = runs.join(tracker, "account_id").select("account_id", "week", "ran_today", F.inline(contract))
    expected = expected.where(~F.col("conditional") | F.col("ran_today")).select("account_id", "week", "pattern")
    actual = ev.select(F.concat_ws("/", "account_id", "week", "event_type").alias("name"))
    gaps = ql.contract_gaps(expected, actual, {"account": F.col("account_id"), "week": F.col("week")})
    return gaps.select("name", "account_id", "week")


@query(
    "schema_violations",
    "FLT-9",
    """SELECT doc_id, unnest(list_filter([CASE WHEN text IS NULL OR trim(text) = '' THEN 'text is empty' END,
    CASE WHEN lang NOT IN ('en', 'de') THEN 'lang is not a valid value' END,
    CASE WHEN n_chars <> length(text) THEN 'n_chars does not match' END,
    CASE WHEN contains(lower(text), 'see document') OR length(text) < 40 THEN 'placeholder text' END,
    CASE WHEN quality IS NULL THEN 'missing required field quality' END,
    CASE WHEN source = 'src1' AND coalesce(toxic, 1) = 1 THEN 'structural: toxic must be 0' END], lambda x: x IS NOT NULL))
    AS violation FROM documents LEFT JOIN labels USING (doc_id)""",
)
def schema_violations(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", "left")
    text = F.col("text")
    rules = [
        (text.isNull() | (F.trim(text) == ""), "text is empty"),
        (~F.col("lang").isin("en", "de"), "lang is not a valid value"),
        (F.col("n_chars") != F.length(text), "n_chars does not match"),
        (F.lower(text).contains("see document") | (F.length(text) < 40), "placeholder text"),
        (F.col("quality").isNull(), "missing required field quality"),
        ((F.col("source") == "src1") & (F.coalesce("toxic", F.lit(1)) == 1), "structural: toxic must be 0"),
    ]
    return ql.violations(docs, rules, ["doc_id"])


@query(
    "asset_eligibility",
    "FLT-11",
    compose(
        f"""SELECT asset_id, CAST(last_date AS VARCHAR) AS last_date, last_price, avg_volume, (last_price - m) / abs(m) * 100
        AS month_change_pct, (last_price - f) / abs(f) * 100 AS window_change_pct, reason, reason = '' AS eligible FROM (
        SELECT *, CASE WHEN DATE '2001-11-06' - last_date > 7 THEN 'stale' WHEN floor(avg_volume) < 30 THEN 'illiquid'
        ELSE '' END AS reason FROM (SELECT asset_id, max(price_date) AS last_date, max(close) FILTER (pos = 1) AS last_price,
        avg(volume) FILTER (pos <= 20) AS avg_volume, max(close) FILTER (pos = least(22, n)) AS m, max(close) FILTER (pos = n)
        AS f FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY price_date DESC) AS pos, count(*) OVER
        (PARTITION BY asset_id) AS n FROM prices) GROUP BY 1))""",
        "prices",
    ),
    "last_price avg_volume month_change_pct window_change_pct",
)
def asset_eligibility(spark, sf):
    return ql.eligibility(b.prices(spark, sf), "asset_id", "price_date", "close", "volume", "2001-11-06", min_volume=30.0)


@query(
    "ambiguity_band",
    "FLT-13",
    compose(
        """SELECT entity_id, CAST(month AS VARCHAR) AS month, abs(unrate / 5.0 - 1) <= 0.1 AS ambiguous, abs(indpro_yoy / 15.0
        - 1) <= 0.1 AS momentum_ambiguous FROM wide""",
        "wide",
    ),
)
def ambiguity_band(spark, sf):
    wide = regime.aligned(b.observations(spark, sf))
    return wide.select(
        "entity_id",
        "month",
        ql.ambiguity_band(F.col("unrate"), 5.0).alias("ambiguous"),
        ql.ambiguity_band(F.col("indpro_yoy"), 15.0).alias("momentum_ambiguous"),
    )


def _fit(score: str, positive: str) -> str:
    return f"coalesce(abs({score}) < 0.15 OR ({positive} AND {score} > 0) OR (NOT {positive} AND {score} < 0), true)"


@query(
    "coordinate_consistency",
    "FLT-14",
    compose(
        f"""SELECT *, growth_ok AND inflation_ok AND liquidity_ok AS consistent FROM (SELECT entity_id, CAST(month AS VARCHAR)
        AS month, {_fit('growth_score', "regime IN ('Goldilocks', 'Overheating')")} AS growth_ok, {_fit('inflation_score',
        "regime IN ('Overheating', 'Stagflation')")} AS inflation_ok, {_fit('liquidity_score', "(liquidity_binary = 'loose')")}
        AS liquidity_ok FROM regimes)""",
        "regimes",
    ),
)
def coordinate_consistency(spark, sf):
    return ql.coordinate_consistency(regimes(spark, sf))


@query(
    "companion_check",
    "FLT-15",
    """SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'structural' WHEN 0 THEN 'tactical' END, lang, 'unknown') AS class,
    CASE WHEN quality IS NULL THEN 'missing' ELSE 'not updated' END AS problem FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NULL OR toxic = 1""",
)
def companion_check(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("doc_class"))
    records = b.table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "structural").when(F.col("quality") == 0, "tactical").alias("record_class"),
        F.when(F.col("toxic") == 1, "2024-01-01").otherwise("2024-01-30").alias("updated"),
    )
    return ql.companions(docs, records, "doc_id", "2024-01-30")


@query(
    "companion_check_of_one",
    "FLT-15",
    """SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'structural' WHEN 0 THEN 'tactical' END, lang, 'unknown') AS class, CASE WHEN quality IS NULL THEN
    'missing' ELSE 'not updated' END AS problem FROM documents LEFT JOIN labels USING (doc_id) WHERE source = 'src3' AND (quality IS NULL OR toxic = 1)
    UNION ALL SELECT -1, 'unknown', 'unknown producer nobody'""",
)
def companion_check_of_one(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("doc_class"), F.col("source").alias("producer"))
    records = b.table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "structural").when(F.col("quality") == 0, "tactical").alias("record_class"),
        F.when(F.col("toxic") == 1, "2024-01-01").otherwise("2024-01-30").alias("updated"),
    )
    return ql.companions(docs, records, "doc_id", "2024-01-30", "src3").unionByName(ql.companions(docs, records, "doc_id", "2024-01-30", "nobody")).fillna(-1, ["doc_id"])


#: One nested record per part, as text that both engines build alike; the remainders of the key break one rule each.
_RECORD_SQL = """concat('{"name": ', CASE WHEN p_partkey % 11 = 0 THEN '7' ELSE concat('"', p_brand, '"') END, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat(',
    "conviction": "', CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'High' END, '"') END, ', "mechanism": ', CASE p_partkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN
    '[{"link": "See document"}]' WHEN 2 THEN '"rates fall"' ELSE '[{"link": "rates fall"}, {"link": "prices rise"}]' END, ', "assumptions": ', CASE p_partkey % 6
    WHEN 0 THEN '[]' WHEN 1 THEN '[3, {"text": "a", "status": "intact"}]' WHEN 2 THEN '[{"status": "odd"}]' WHEN 3 THEN '[{"text": "See document", "status":
    "broken"}]' ELSE '[{"text": "a", "status": "intact"}, {"text": "b"}]' END, ', "trade": ', CASE p_partkey % 3 WHEN 0 THEN '{"how_long": null}' WHEN 1 THEN
    '{"when_to_get_out": "x", "how_long": "y", "when_to_buy": "z"}' ELSE '[1]' END, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ', "stress": {"risks": [],
    "counter": ""}' WHEN 2 THEN ', "stress": {"primary": "see document"}' ELSE ', "stress": {"counter": "demand"}' END, '}')"""
_RECORD_RULES = (
    ql.Rule("name"),
    ql.Rule("conviction", filled=True),
    ql.Rule("mechanism", "array", stub="link"),
    ql.Rule("assumptions", "array", filled=True, stub="text", fields=(ql.Rule("text", present=True), ql.Rule("status", values=("intact", "weakening", "broken")))),
    ql.Rule("trade", "object", fields=(ql.Rule("when_to_get_out", present=True), ql.Rule("how_long", present=True), ql.Rule("when_to_buy", present=True, of_class="structural"))),
    ql.Rule("stress", "object", stub="primary", any_of=("counter", "risks"), of_class="structural"),
)


@query(
    "record_violations",
    "FLT-9",
    f"""SELECT p_partkey, unnest(list_filter(list_concat([CASE WHEN p_partkey % 11 = 0 THEN 'name must be string, got number' END, CASE WHEN p_partkey % 13 = 0 THEN
    'conviction is missing' WHEN trim(json_extract_string(r, '$.conviction')) = '' THEN 'conviction is empty' END, CASE WHEN coalesce(json_type(r, '$.mechanism'), 'NULL')
    = 'NULL' THEN 'mechanism is missing' WHEN json_type(r, '$.mechanism') <> 'ARRAY' THEN 'mechanism must be array, got string' WHEN json_array_length(r, '$.mechanism') = 1
    AND contains(lower(json_extract_string(r, '$.mechanism[0].link')), 'see document') THEN 'mechanism holds a placeholder' END, CASE WHEN json_array_length(r,
    '$.assumptions') = 0 THEN 'assumptions is empty' END, CASE WHEN json_array_length(r, '$.assumptions') = 1 AND contains(lower(coalesce(json_extract_string(r,
    '$.assumptions[0].text'), '')), 'see document') THEN 'assumptions holds a placeholder' END, CASE WHEN json_type(r, '$.trade') <> 'OBJECT' THEN
    'trade must be object, got array' END, CASE WHEN json_type(r, '$.trade') = 'OBJECT' AND json_extract_string(r, '$.trade.when_to_get_out') IS NULL THEN
    'trade.when_to_get_out is missing' END, CASE WHEN json_type(r, '$.trade') = 'OBJECT' AND json_extract_string(r, '$.trade.how_long') IS NULL THEN
    'trade.how_long is missing' END, CASE WHEN json_type(r, '$.trade') = 'OBJECT' AND structural AND json_extract_string(r, '$.trade.when_to_buy') IS NULL THEN
    'trade.when_to_buy is missing' END, CASE WHEN structural AND json_type(r, '$.stress') IS NULL THEN 'stress is missing' WHEN structural AND contains(lower(coalesce(
    json_extract_string(r, '$.stress.primary'), '')), 'see document') THEN 'stress holds a placeholder' END, CASE WHEN structural AND json_type(r, '$.stress') = 'OBJECT' AND
    coalesce(json_extract_string(r, '$.stress.counter'), '') = '' AND coalesce(json_array_length(r, '$.stress.risks'), 0) = 0 THEN 'stress has neither counter nor risks' END],
    list_concat(list_transform(range(CAST(json_array_length(r, '$.assumptions') AS BIGINT)), lambda i: CASE WHEN json_type(r, '$.assumptions[' || i || ']') <> 'OBJECT' THEN 'assumptions['
    || i || '] must be object, got number' WHEN json_type(r, '$.assumptions[' || i || '].text') IS NULL THEN 'assumptions[' || i || '].text is missing' END),
    list_transform(range(CAST(json_array_length(r, '$.assumptions') AS BIGINT)), lambda i: CASE WHEN json_type(r, '$.assumptions[' || i || ']') = 'OBJECT' THEN CASE WHEN json_type(r,
    '$.assumptions[' || i || '].status') IS NULL THEN 'assumptions[' || i || '].status is missing' WHEN json_extract_string(r, '$.assumptions[' || i || '].status') NOT IN
    ('intact', 'weakening', 'broken') THEN 'assumptions[' || i || '].status is not a valid value: ' || json_extract_string(r, '$.assumptions[' || i || '].status') END END))),
    lambda x: x IS NOT NULL)) AS violation FROM (SELECT p_partkey, p_size % 2 = 0 AS structural, {_RECORD_SQL} AS r FROM part)""",
)
def record_violations(spark, sf):
    parts = b.table(spark, sf, "part").select("p_partkey", F.expr(_RECORD_SQL).alias("r"), F.when(F.col("p_size") % 2 == 0, "structural").otherwise("tactical").alias("class"))
    return ql.record_violations(parts, "r", _RECORD_RULES, F.col("class"), ["p_partkey"])


@query(
    "required_config",
    "FLT-16",
    """SELECT event_id, k.key AS key FROM events, (VALUES ('k'), ('account')) k(key) WHERE coalesce(json_extract_string(props,
    '$.' || k.key), '') = ''""",
)
def required_config(spark, sf):
    props = F.from_json("props", "MAP<STRING,STRING>")
    rows = b.table(spark, sf, "events").select("event_id", props.alias("p"))
    return rows.select("event_id", "p", F.explode(F.array(F.lit("k"), F.lit("account"))).alias("key")).where(
        F.coalesce(F.try_element_at("p", F.col("key")), F.lit("")) == ""
    ).select("event_id", "key")


@query(
    "forecast_sanity",
    "FLT-18",
    compose(
        """SELECT entity_id, CAST(horizon AS BIGINT) AS horizon, source, target, prob, base_rate, abs(prob - base_rate) > 0.2
        AS far_from_base, abs(sum(prob) OVER (PARTITION BY entity_id, horizon, source) - 1) > 0.01 AS bad_total FROM (SELECT
        entity_id, horizon, source, target, round(prob, 9) AS prob, round(shrunk, 9) AS base_rate FROM shrunk
        WHERE prob IS NOT NULL)""",
        "shrunk",
    ),
    "prob base_rate",
)
def forecast_sanity(spark, sf):
    made = shrunk(spark, sf).where(F.col("prob").isNotNull())
    return ql.forecast_sanity(
        made.select("entity_id", "horizon", "source", "target", F.round("prob", 9).alias("prob"), F.round("shrunk", 9).alias("base_rate")),
        keys=("entity_id", "horizon", "source"),
    )


@query(
    "collection_stats",
    "AGG-42",
    """SELECT coalesce(source, 'all') AS source, count(*) AS n, count(*) FILTER (length(text) < 400) AS errors,
    avg(CASE WHEN length(text) < 400 THEN 0.0::DOUBLE ELSE 100 END) AS success_pct FROM documents GROUP BY ROLLUP (source)""",
    "success_pct",
)
def collection_stats(spark, sf):
    return ql.collection_stats(b.table(spark, sf, "documents"), "source", F.length("text") < 400)
