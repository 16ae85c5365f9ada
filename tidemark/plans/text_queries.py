"""Registered queries: structured rows from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import CODE_PATTERN, ISSUE_PHRASES, NOT_CODES, QUANTITY_PATTERN
from tidemark.operators import quality as ql, text as tx
from tidemark.plans import bindings as b
from tidemark.plans.cte import compose, cte
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import readers

_ORD = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag, l_linestatus"


def _int(x: str) -> str:
    return f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"


cte(
    "doc_lines",
    f"""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) AS i, {_ORD} FROM lineitem""",
)
cte(
    "docs",
    f"""SELECT o_orderkey AS doc_id, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '# STRUCTURAL THESIS: Order ' ELSE '# THESIS: Order ' END ||
    o_orderkey || chr(10) || '**Status:** ' || CASE WHEN o_orderstatus = 'F' THEN 'Active since start' ELSE 'DRAFT' END || CASE o_orderpriority WHEN
    '1-URGENT' THEN chr(10) || '**Conviction:** High (tactical)' WHEN '2-HIGH' THEN chr(10) || '**Conviction:** medium-high' WHEN '3-MEDIUM' THEN chr(10)
    || '**Conviction:** Medium' ELSE '' END || chr(10) || chr(10) || '## Summary' || chr(10) || 'We buy SPY and **XLE** here. Regime: Stagflation — ' ||
    CASE WHEN n % 2 = 0 THEN 'Ample' ELSE 'Tight' END || ' Liquidity. Growth score: 0.' || n || ', Inflation axis: -' || n || '.5, ' || n ||
    ' consecutive weeks of Stagflation. Confidence: High' || chr(10) || '## What Has To Stay True' || chr(10) || items || chr(10) || '## The Trade' || chr(10)
    || '| Asset | Direction | ETF | Rationale |' || chr(10) || '|---|:---|---|---|' || chr(10) || rws || chr(10) || chr(10) || '## Sector View' || chr(10)
    || prose AS text FROM orders JOIN (SELECT l_orderkey, count(*) AS n, string_agg(i || '. Part ' || l_partkey || ' holds $' || {_int('l_extendedprice')}
    || 'K and ' || {_int('l_discount * 100')} || '% — Testable by: review ' || l_suppkey || '. Current status: ' || CASE WHEN l_linestatus = 'F' THEN
    'INTACT' ELSE 'UNDER PRESSURE' END || chr(10) || '   - volume ' || {_int('l_quantity')} || ' tonnes', chr(10) ORDER BY i) AS items,
    string_agg('| **Part ' || l_partkey || '** | ' || CASE WHEN l_discount > 0.05 THEN 'strong overweight' WHEN l_discount > 0.02 THEN 'neutral' ELSE
    'avoid' END || ' | ' || CASE l_returnflag WHEN 'R' THEN 'SPY / EUR' WHEN 'A' THEN 'GLD' ELSE '' END || ' | Held with TLT for ' || {_int('l_quantity')}
    || ' weeks |', chr(10) ORDER BY i) AS rws, string_agg(CASE l_returnflag WHEN 'R' THEN '**Energy (' WHEN 'A' THEN '**Basic Materials (' ELSE
    '**Utilities (' END || CASE WHEN l_linestatus = 'F' THEN 'Overweight' ELSE 'Neutral' END || '):** Body of XLE part ' || l_partkey ||
    '. **Reassessment trigger:** price above ' || {_int('l_quantity')} || '. ', '' ORDER BY i) AS prose FROM doc_lines GROUP BY 1) ON o_orderkey =
    l_orderkey""",
    "doc_lines",
)


def _codes(x: str) -> str:
    noise = ", ".join(f"'{w}'" for w in NOT_CODES)
    return f"list_filter(regexp_extract_all({x}, '{CODE_PATTERN}'), lambda c: c NOT IN ({noise}))"


cte(
    "sections",
    """SELECT doc_id, ord, CASE WHEN ord = 0 THEN 0 ELSE 2 END AS level, CASE WHEN ord = 0 THEN '_preamble' ELSE max(CASE WHEN head THEN
    trim(regexp_replace(line, '^##\\s+', '')) END) END AS heading, trim(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos),
    ' ' || chr(10)) AS body FROM (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ord FROM (SELECT doc_id,
    pos, line, starts_with(line, '## ') AS head FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs))) GROUP BY doc_id, ord""",
    "docs",
)


@query(
    "markdown_documents",
    "SRC-13",
    compose("SELECT doc_id, text FROM docs", "docs"),
)
def markdown_documents(spark, sf):
    return b.thesis_docs(spark, sf).select("doc_id", "text")


@query(
    "landed_documents",
    "SRC-13",
    "SELECT CAST(item_id AS VARCHAR) AS doc_id, text FROM benchmark",
)
def landed_documents(spark, sf):
    """Every benchmark text written to a file of its own and read back whole; the writer ends a file with a line feed."""
    root = scratch_path(spark, "documents")
    b.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text").write.partitionBy("doc_id").text(root)
    return readers.read_documents(spark, root).select("doc_id", F.regexp_replace("text", r"\n\z", "").alias("text"))


@query(
    "document_sections",
    "TXT-1",
    compose(
        "SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(level AS BIGINT) AS level, heading, coalesce(body, '') AS body FROM sections", "sections"
    ),
)
def document_sections(spark, sf):
    return tx.sections(b.thesis_docs(spark, sf), "doc_id")


@query(
    "conversation_sections",
    "TXT-1",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, CAST(2 AS BIGINT) AS level, role || ' ' || turn AS heading,
    trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS body FROM conversations""",
)
def conversation_sections(spark, sf):
    turns = b.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts")
    )
    text = F.array_join(
        F.transform("ts", lambda t: F.concat(F.lit("## "), t["role"], F.lit(" "), t["turn"].cast("string"), F.lit("\n"), t["text"])), "\n"
    )
    docs = turns.select("conv_id", F.concat(F.lit("# Conversation\n"), text).alias("text"))
    return tx.sections(docs, "conv_id").where(F.col("ord") > 0)


cte(
    "table_rows",
    """SELECT doc_id, (i - 1) AS row_no, 'Part ' || l_partkey AS what, CASE WHEN l_discount > 0.05 THEN 'strong overweight' WHEN l_discount > 0.02 THEN
    'neutral' ELSE 'avoid' END AS direction, CASE l_returnflag WHEN 'R' THEN 'SPY / EUR' WHEN 'A' THEN 'GLD' ELSE '' END AS etf, 'Held with TLT for ' ||
    CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ' weeks' AS rationale FROM doc_lines JOIN (SELECT o_orderkey AS doc_id FROM orders) ON l_orderkey
    = doc_id""",
    "doc_lines",
)


@query(
    "pipe_tables",
    "TXT-2 TXT-3",
    compose("SELECT doc_id, row_no, what AS asset, etf, rationale FROM table_rows", "table_rows"),
)
def pipe_tables(spark, sf):
    rows = tx.pipe_tables(b.thesis_docs(spark, sf), "doc_id")
    c = F.col("cells")
    return rows.select(
        "doc_id", F.col("row_no").cast("bigint").alias("row_no"), tx.first_present(c, "asset class", "asset").alias("asset"),
        tx.first_present(c, "etf expression", "etf").alias("etf"), tx.first_present(c, "rationale").alias("rationale"),
    )


@query(
    "canonical_rows",
    "TXT-12 TXT-8",
    compose(
        """SELECT doc_id, row_no, what, direction, CASE etf WHEN 'SPY / EUR' THEN 'SPY' WHEN 'GLD' THEN 'GLD' ELSE '' END AS codes, CASE direction WHEN
        'strong overweight' THEN 'high' WHEN 'neutral' THEN 'low' ELSE 'medium' END AS conviction, rationale AS why, '' AS timing FROM table_rows""",
        "table_rows",
    ),
)
def canonical_rows(spark, sf):
    rows = tx.pipe_tables(b.thesis_docs(spark, sf), "doc_id").withColumn("row_no", F.col("row_no").cast("bigint"))
    return tx.asset_rows(rows, ["doc_id", "row_no"])


@query(
    "document_meta",
    "TXT-4",
    compose(
        """SELECT doc_id, CASE WHEN contains(upper(regexp_extract(text, '\\*\\*Status:\\*\\*\\s*([^\\n]+)', 1)), 'ACTIVE') THEN 'ACTIVE' ELSE 'DRAFT' END AS
        status, CASE WHEN contains(text, '**Conviction:** High') THEN 'High' WHEN contains(text, '**Conviction:** medium-high') THEN 'Medium-High' WHEN
        contains(text, '**Conviction:** Medium') THEN 'Medium' ELSE 'Unknown' END AS conviction, CASE WHEN contains(text, 'STRUCTURAL') THEN 'structural' ELSE
        'tactical' END AS classification FROM docs""",
        "docs",
    ),
)
def document_meta(spark, sf):
    t = F.col("text")
    return b.thesis_docs(spark, sf).select(
        "doc_id", tx.status_of(t).alias("status"), tx.conviction_of(t).alias("conviction"), tx.classification_of(t).alias("classification")
    )


@query(
    "meta_fields",
    "TXT-4",
    compose(
        r"""SELECT doc_id, trim(split_part(rest, ':**', 1)) AS name, trim(substr(rest, strpos(rest, ':**') + 3)) AS value FROM (SELECT doc_id, substr(line, 3) AS rest
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE starts_with(line, '**') AND contains(line, ':**'))""",
        "docs",
    ),
)
def meta_fields(spark, sf):
    return tx.meta_fields(b.thesis_docs(spark, sf), "doc_id").select("doc_id", "name", "value")


def _assumptions(spark, sf):
    parts = tx.sections(b.thesis_docs(spark, sf), "doc_id").where(F.col("heading") == "What Has To Stay True")
    return tx.numbered_items(parts, ["doc_id"])


cte(
    "items",
    """SELECT l_orderkey AS doc_id, i AS step, 'Part ' || l_partkey || ' holds $' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || 'K and ' ||
    CAST(CAST(floor(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS core, 'review ' || l_suppkey AS testable_by, CASE WHEN l_linestatus = 'F' THEN
    'INTACT' ELSE 'UNDER PRESSURE' END AS status, 'Testable by: review ' || l_suppkey AS source, '$' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS
    VARCHAR) || 'K; ' || CAST(CAST(floor(l_discount * 100) AS BIGINT) AS VARCHAR) || '%; ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) ||
    ' tonnes' AS quantified FROM doc_lines JOIN orders ON l_orderkey = o_orderkey""",
    "doc_lines",
)


@query(
    "numbered_items",
    "TXT-5 TXT-6",
    compose("SELECT doc_id, step, core, testable_by, status, source, quantified FROM items", "items"),
)
def numbered_items(spark, sf):
    return _assumptions(spark, sf).drop("item", "title")


@query(
    "quantities",
    "TXT-6",
    f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{QUANTITY_PATTERN}'), ' ; ') AS found FROM documents""",
)
def quantities(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.array_join(tx.quantities(F.col("text")), " ; ").alias("found"))


@query(
    "code_mentions",
    "TXT-7",
    f"""SELECT code, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_codes('text')}) AS code FROM documents)
    GROUP BY 1""",
)
def code_mentions(spark, sf):
    return tx.code_mentions(b.table(spark, sf, "documents"), "text")


@query(
    "trade_directions",
    "TXT-8",
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'reduce|exit|avoid|underweight') THEN 'cautious' WHEN regexp_matches(lower(text),
    'overweight|long|buy') THEN 'long' ELSE 'neutral' END AS direction FROM conversations""",
)
def trade_directions(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", tx.trade_direction(F.col("text")).alias("direction"))


@query(
    "regime_mentions",
    "TXT-9",
    """SELECT doc_id, 'Stagflation — ' || CASE WHEN n % 2 = 0 THEN 'Ample' ELSE 'Tight' END || ' Liquidity' AS regime, 'Stagflation' AS family, CASE WHEN
        n % 2 = 0 THEN 'ample' ELSE 'tight' END AS liquidity, least(1.0::DOUBLE, ('0.' || n)::DOUBLE) AS growth_score, -1.0::DOUBLE AS inflation_score,
        0.0::DOUBLE AS liquidity_score, n AS weeks, 'High' AS confidence FROM (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem JOIN orders ON
        l_orderkey = o_orderkey GROUP BY 1)""",
    "growth_score inflation_score liquidity_score",
)
def regime_mentions(spark, sf):
    return tx.regime_mentions(b.thesis_docs(spark, sf), "doc_id")


@query(
    "first_sentences",
    "TXT-10",
    r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '^([^\n]*?[.!?])\s+\p{Lu}', 1), ''), text) AS sentence FROM documents""",
)
def first_sentences(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", tx.first_sentence(F.col("text")).alias("sentence"))


@query(
    "labelled_blocks",
    "TXT-13",
    compose(
        """SELECT l_orderkey AS doc_id, i - 1 AS block_no, CASE l_returnflag WHEN 'R' THEN 'Energy' WHEN 'A' THEN 'Basic Materials' ELSE 'Utilities' END AS
        name, CASE WHEN l_linestatus = 'F' THEN 'Overweight' ELSE 'Neutral' END AS direction, CASE WHEN l_linestatus = 'F' THEN 'High' ELSE 'Low' END AS
        conviction, 'price above ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS trigger, 'Body of XLE part ' || l_partkey || '.' AS body, 'XLE' AS
        codes FROM doc_lines JOIN orders ON l_orderkey = o_orderkey""",
        "doc_lines",
    ),
)
def labelled_blocks(spark, sf):
    parts = tx.sections(b.thesis_docs(spark, sf), "doc_id").where(F.col("heading") == "Sector View")
    return tx.labelled_blocks(parts, ["doc_id"], "body")


cte(
    "records",
    """SELECT doc_id, CASE WHEN o_orderstatus = 'F' THEN 'ACTIVE' ELSE 'DRAFT' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH'
    THEN 'Medium-High' WHEN '3-MEDIUM' THEN 'Medium' ELSE CASE WHEN doc_id % 2 = 0 THEN 'Low' ELSE 'Unknown' END END AS conviction, CASE WHEN
    o_orderpriority = '1-URGENT' THEN 'structural' ELSE 'tactical' END AS classification, n, doc_id % 2 = 0 AS known FROM (SELECT l_orderkey AS doc_id, count(*)
    AS n FROM lineitem GROUP BY 1) JOIN orders ON doc_id = o_orderkey""",
)


def _previous(spark, sf):
    orders = b.table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == 0)
    entry = lambda d, c: F.struct(F.lit(d).alias("date"), F.lit(c).alias("change"))
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.lit("DRAFT").alias("status"),
        F.lit("Low").alias("conviction"),
        F.array(entry("2023-12-01", "created"), entry("2024-01-30", "first run today")).alias("change_log"),
    )


def _records(spark, sf):
    return tx.thesis_records(b.thesis_docs(spark, sf), "doc_id", _previous(spark, sf), "2024-01-30")


@query(
    "thesis_records",
    "TXT-14 JN-15",
    compose(
        """SELECT doc_id, status, conviction, classification, n AS n_assumptions, CASE WHEN known THEN CASE WHEN chg = '' THEN
        '2023-12-01 created|2024-01-30 first run today' ELSE '2023-12-01 created|2024-01-30 ' || chg END ELSE '2024-01-30 ' || chg END AS log FROM (SELECT *,
        concat_ws('; ', CASE WHEN known THEN CASE WHEN status <> 'DRAFT' THEN 'status DRAFT to ' || status END ELSE 'status none to ' || status END, CASE WHEN
        known THEN CASE WHEN conviction <> 'Low' THEN 'conviction Low to ' || conviction END ELSE 'conviction none to ' || conviction END) AS chg
        FROM records)""",
        "records",
    ),
)
def thesis_records(spark, sf):
    log = F.array_join(F.transform("change_log", lambda e: F.concat(e["date"], F.lit(" "), e["change"])), "|")
    return _records(spark, sf).select(
        "doc_id", "status", "conviction", "classification", F.size("assumptions").alias("n_assumptions"), log.alias("log")
    )


@query(
    "thesis_changes",
    "TXT-14 JN-15",
    compose(
        """SELECT r.doc_id, CASE WHEN known AND chg = '' THEN '2023-12-01 created|2024-01-30 first run today' ELSE CASE WHEN known THEN
        '2023-12-01 created|' ELSE '' END || '2024-01-30 ' || chg END AS log FROM (SELECT records.doc_id, known, concat_ws('; ', CASE WHEN known THEN CASE
        WHEN status <> 'DRAFT' THEN 'status DRAFT to ' || status END ELSE 'status none to ' || status END, CASE WHEN known THEN CASE WHEN conviction <> 'Low'
        THEN 'conviction Low to ' || conviction END ELSE 'conviction none to ' || conviction END, CASE WHEN known THEN moves END, CASE WHEN known AND n_old <>
        n THEN 'assumptions ' || n_old || ' to ' || n END) AS chg FROM records JOIN (SELECT doc_id, sum(n_old) AS n_old, string_agg('assumption "' || core ||
        '" ' || old || ' to ' || new, '; ' ORDER BY i) FILTER (WHERE old <> new) AS moves FROM (SELECT l_orderkey AS doc_id, core, min(i) AS i, arg_max(new, i)
        AS new, arg_max(old, i) FILTER (WHERE kept) AS old, count(*) FILTER (WHERE kept) AS n_old FROM (SELECT l_orderkey, i, 'Part ' || l_partkey ||
        ' holds $' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || 'K and ' || CAST(CAST(floor(l_discount * 100) AS BIGINT) AS VARCHAR) || '%' AS
        core, CASE WHEN l_linestatus = 'F' THEN 'INTACT' ELSE 'UNDER PRESSURE' END AS new, CASE WHEN l_returnflag = 'R' THEN 'INTACT' ELSE 'UNDER PRESSURE' END
        AS old, l_discount < 0.075 AS kept FROM doc_lines) GROUP BY 1, 2) GROUP BY 1) AS a ON records.doc_id = a.doc_id) AS r""",
        "records",
        "doc_lines",
    ),
)
def thesis_changes(spark, sf):
    """The earlier version lacks lines of a high discount and had other statuses."""
    old = b.earlier_assumptions(spark, sf, F.col("l_discount") < 0.075)
    records = tx.thesis_records(b.thesis_docs(spark, sf), "doc_id", _previous(spark, sf).join(old, "doc_id", "left"), "2024-01-30")
    log = F.array_join(F.transform("change_log", lambda e: F.concat(e["date"], F.lit(" "), e["change"])), "|")
    return records.select("doc_id", log.alias("log"))


@query(
    "counter_arguments",
    "TXT-13",
    """SELECT l_orderkey AS doc_id, 'Demand falls by 2.5%.' AS strongest, string_agg('Part ' || l_partkey || ' **fails**' || CASE WHEN l_returnflag = 'R'
    THEN '. Probability: ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '.5% a year. Watch it' ELSE chr(10) || '  and stays so' END || ' / ' ||
    CASE WHEN l_returnflag = 'R' THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '.5% a year' ELSE 'Unknown' END, ' | ' ORDER BY l_linenumber,
    l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS risks, 'Medium' AS assessment FROM lineitem GROUP BY 1""",
)
def counter_arguments(spark, sf):
    found = b.contested_docs(spark, sf).select("doc_id", tx.counter_argument(tx.section_of(F.col("text"), "What Could Break It")).alias("c"))
    risks = F.array_join(F.transform("c.key_risks", lambda r: F.concat(r["risk"], F.lit(" / "), r["probability"])), " | ")
    return found.select("doc_id", "c.strongest", risks.alias("risks"), "c.assessment")


@query(
    "external_views",
    "TXT-13",
    """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
    l_linestatus) - 1 AS view_no, 'Supplier ' || l_suppkey AS name, CASE WHEN l_linestatus = 'F' THEN '2024-01-15' END AS dated, CASE WHEN l_linestatus =
    'F' THEN 'We **hold** ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ' tonnes' || chr(10) || '  until sold' ELSE '' END AS quote, CASE WHEN
    l_linestatus = 'F' THEN 'Supports' ELSE 'Challenges at 2.5%' END AS alignment FROM lineitem""",
)
def external_views(spark, sf):
    views = tx.named_views(tx.section_of(F.col("text"), "External Views"))
    return b.contested_docs(spark, sf).select("doc_id", F.posexplode(views).alias("view_no", "v")).select("doc_id", F.col("view_no").cast("bigint").alias("view_no"), "v.*")


@query(
    "theses_index",
    "TXT-11",
    compose(
        """SELECT doc_id, status, conviction, classification, 'Order ' || doc_id AS name, '' AS recommendation, '' AS kill_switch, 'long' AS direction, 'We buy SPY and XLE here.' AS what, 'SPY, XLE' AS codes, n AS n_assumptions
        FROM records""",
        "records",
    ),
)
def theses_index(spark, sf):
    return tx.theses_index(_records(spark, sf), "doc_id")


@query(
    "overlaid_fields",
    "TXT-15",
    """SELECT o_orderkey AS doc_id, 'High' AS confidence, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_totalprice > 100000 THEN 'Goldilocks' END END,
    'Stagflation') AS family FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def overlaid_fields(spark, sf):
    parsed = tx.regime_mentions(b.thesis_docs(spark, sf), "doc_id").select("doc_id", "confidence", "family")
    structured = b.table(spark, sf, "orders").where(F.col("o_orderkey") % 3 == 0).select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_totalprice") > 100000, "Goldilocks").alias("family")
    )
    return tx.overlay_fields(parsed, structured, "doc_id", ["family"])


@query(
    "parse_fidelity",
    "FLT-10",
    """SELECT o_orderkey AS doc_id, count(*) AS n_source, count(*) AS n_parsed, CAST(0 AS BIGINT) AS n_truncated, false AS mismatch FROM lineitem JOIN orders ON
    l_orderkey = o_orderkey GROUP BY 1""",
)
def parse_fidelity(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    known = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return ql.fidelity(lines.join(known, "doc_id"), _assumptions(spark, sf), ["doc_id"], "core")


THEMES = ("red gold", "small widget", "blue copper oil", "hot bolt")


def _score_sql(theme: str) -> str:
    hits = " + ".join(f"contains(lower(p_name), '{w}')::INT + contains(lower(p_brand), '{w}')::INT" for w in tx.expand_theme(theme))
    return f"""SELECT '{theme}' AS theme, p_partkey, p_name, CAST(h + (h > 1)::INT AS BIGINT) AS score FROM (SELECT *, {hits} + CASE WHEN
    contains(lower(p_name), '{theme}') THEN 3 ELSE 0 END AS h FROM part) WHERE h > 0"""


@query(
    "keyword_rank",
    "TOP-3",
    f"""SELECT theme, p_partkey, p_name, score, row_number() OVER (PARTITION BY theme ORDER BY score DESC, p_partkey) AS rank FROM (
    {' UNION ALL '.join(_score_sql(t) for t in THEMES)}) QUALIFY rank <= 5""",
)
def keyword_rank(spark, sf):
    return tx.keyword_rank(b.table(spark, sf, "part"), THEMES, "p_partkey", "p_brand", "p_name")


@query(
    "superseded_documents",
    "TOP-6",
    """SELECT o_custkey, doc_id, status FROM (SELECT o_custkey, o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'ACTIVE' ELSE 'DRAFT' END AS status FROM
    orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY status, doc_id) = 1""",
)
def superseded_documents(spark, sf):
    docs = b.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("DRAFT").alias("status")
    )
    return tx.supersede(docs, "o_custkey", "status", ["doc_id"])


@query(
    "uncovered_impacts",
    "SET-5",
    """SELECT force, level, tag FROM (SELECT p_brand AS force, CAST(2 AS BIGINT) AS level, p_type || ' ' || p_size AS tag FROM part WHERE p_size < 25 UNION SELECT
    p_brand, 3, p_type || ' ' || p_size FROM part WHERE p_size >= 25) WHERE tag NOT IN (SELECT p_type || ' ' || p_size FROM part WHERE p_retailprice > 1080)""",
)
def uncovered_impacts(spark, sf):
    part = b.table(spark, sf, "part")
    tag = F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"))
    small = F.col("p_size") < 25
    # A force's impact lists are sets of tags, bounded by the tag vocabulary (types times sizes).
    forces = part.groupBy(F.col("p_brand").alias("force")).agg(
        F.collect_set(F.when(small, tag)).alias("second_order"), F.collect_set(F.when(~small, tag)).alias("third_order")
    )
    return tx.uncovered_impacts(forces, part.where(F.col("p_retailprice") > 1080).select(tag.alias("tag"))).select("force", "level", "tag")


_CAT = {
    name: " OR ".join(f"contains(lower(message), '{p}')" for p in phrases) for name, phrases in ISSUE_PHRASES.items()
}
cte(
    "runlog",
    """SELECT CAST(user_id AS VARCHAR) AS run, CAST(ts AS VARCHAR) AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' ELSE
    'INFO' END AS severity, CASE event_type WHEN 'signup' THEN 'run-start' WHEN 'purchase' THEN 'run-end' ELSE event_type END AS phase, CASE WHEN k < 10 THEN
    'Timeout after ' || k WHEN k < 20 THEN 'retry ' || k WHEN k < 30 THEN 'script failed: exit code ' || k WHEN k < 40 THEN 'Data gap ' || k ELSE 'ok' END AS
    message, CASE WHEN event_type = 'signup' THEN 'IN_PROGRESS' WHEN event_type = 'purchase' AND k > 60 THEN 'COMPLETE' END AS status FROM (SELECT *,
    CAST(json_extract(props, '$.k') AS INT) AS k FROM events)""",
)


@query(
    "run_log_summary",
    "AGG-40 SRC-12",
    compose(
        f"""SELECT run, events, info, warn, error, fatal, started, ended, {', '.join(_CAT)}, run_status, CASE WHEN run_status = 'INCOMPLETE' THEN last END AS last_phase
        FROM (SELECT run, count(*) AS events, count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity =
        'ERROR') AS error, count(*) FILTER (severity = 'FATAL') AS fatal, max(ts) FILTER (phase = 'run-start') AS started, max(ts) FILTER (phase = 'run-end') AS
        ended, {', '.join(f"count(*) FILTER (severity IN ('WARN', 'ERROR', 'FATAL') AND ({c})) AS {n}" for n, c in _CAT.items())}, CASE WHEN bool_or(status =
        'COMPLETE') THEN 'COMPLETE' WHEN bool_or(status = 'IN_PROGRESS') THEN 'INCOMPLETE' ELSE 'UNKNOWN' END AS run_status, arg_max(phase, (ts, seq)) AS last FROM
        runlog GROUP BY 1)""",
        "runlog",
    ),
)
def run_log_summary(spark, sf):
    return tx.run_log_summary(b.run_log(spark, sf), "run")
