"""Chat formatting by quotation linking, in DataFrame functions only.

A line that begins with ``>`` signs is a quote; their number is its level. Lines of one level in a row form a passage. Passages
and their paragraphs are normalised (case, white space) and hashed; a quoted hash is joined to the unquoted hashes of the same
conversation, and the earliest earlier message that has it is the one quoted. Level 1 names the message that is replied to,
deeper levels what that message quoted in turn. A message without a link stands in turn order and begins a thread; a reply
joins the thread of what it replies to. Ordering by ``conv_id, thread, turn`` puts every reply after its original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.columns import fresh
from tidemark.session import materialise

#: What begins a quoted line, and the layout of a formatted turn.
MARK = r"^[ \t]*(?:>[ \t]?)+"
TURN = ("<|", "|>\n", "<|end|>\n")


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def passages(text: Column) -> Column:
    """The passages of a text in order: ``level`` (0 is the message's own) and ``body`` without quote signs."""

    def parsed(line: Column) -> Column:
        sign = F.regexp_extract(line, MARK, 0)
        return F.struct((F.length(sign) - F.length(F.replace(sign, F.lit(">"), F.lit("")))).alias("level"), F.substr(line, F.length(sign) + 1).alias("body"))

    def merged(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
        return once(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            F.get(lines, at)["level"].alias("level"),
            F.array_join(F.transform(F.slice(lines, at + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - at), lambda x: x["body"]), "\n").alias("body"),
        )))

    return once(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), parsed), merged)


def own_text(parts: Column) -> Column:
    """What is left of a message without its quotes; blank lines at either end go."""
    kept = F.array_join(F.transform(F.filter(parts, lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    return F.regexp_replace(F.regexp_replace(kept, r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def units(parts: Column, quoted: bool) -> Column:
    """Distinct ``level, hash`` of the passages of either kind, whole and by paragraph; an own text counts whole as well."""
    wanted = F.filter(parts, lambda p: (p["level"] > 0) if quoted else (p["level"] == 0))

    def pieces(level: Column, body: Column) -> Column:
        return F.transform(F.concat(F.array(body), F.split(body, r"\n[ \t]*\n")), lambda b: F.struct(level.alias("level"), F.trim(F.regexp_replace(F.lower(b), r"\s+", " ")).alias("plain")))

    texts = F.flatten(F.transform(wanted, lambda p: pieces(p["level"], p["body"])))
    if not quoted:
        texts = F.concat(texts, pieces(F.lit(0), own_text(parts)))
    return F.array_distinct(F.transform(F.filter(texts, lambda u: u["plain"] != ""), lambda u: F.struct(u["level"].alias("level"), F.sha2(u["plain"], 256).alias("hash"))))


def links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``conv_id, turn, level, quoted_turn``: which earlier message each quote level of a message comes from.

    Null conversations and turns link with nothing. Originals are summed to one row per (conversation, hash) before the join,
    so a passage that a whole conversation repeats meets its quotes as a single row.
    """
    plain = messages.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    quoting = plain.where(F.col("text").rlike("(?md)" + MARK))
    quotes = materialise(quoting.select("conv_id", "turn", F.explode(units(passages(F.col("text")), True)).alias("u")).select("conv_id", "turn", "u.level", "u.hash").distinct(), "quotes")
    asked = quotes.select("conv_id").distinct()
    originals = plain.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.explode(units(passages(F.col("text")), False)).alias("u"))
    first = originals.groupBy("conv_id", F.col("u.hash").alias("hash")).agg(F.min("turn").alias("quoted_turn"))
    met = quotes.join(first, ["conv_id", "hash"]).where(F.col("quoted_turn") < F.col("turn"))
    # Several passages of a level may come from several messages; the latest of them is the one replied to.
    return met.groupBy("conv_id", "turn", "level").agg(F.max("quoted_turn").alias("quoted_turn"))


def threads(link: DataFrame) -> DataFrame:
    """``conv_id, turn, reply_to, thread, depth, quoted``: parent, first message of the thread, steps to it, levels linked.

    Every round doubles the length of the steps, so the rounds grow with the logarithm of the longest chain of replies. A
    reply's parent is an earlier turn, so chains end.
    """
    parent = link.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "quoted_turn")).alias("p"), F.count("*").alias("quoted"))
    at = materialise(parent.select("conv_id", "turn", F.col("p.quoted_turn").alias("reply_to"), F.col("p.quoted_turn").alias("thread"), F.lit(1).cast("long").alias("depth"), "quoted"), "threads")
    while True:
        above = at.select(F.col("conv_id").alias("of"), F.col("turn").alias("above"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = at.join(above, (F.col("conv_id") == F.col("of")) & (F.col("thread") == F.col("above")), "left").select(
            "conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "quoted", F.col("next").isNotNull().alias("moved")
        )
        at = materialise(joined, "threads")
        if not at.where("moved").limit(1).count():
            return at.drop("moved")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``messages`` with ``reply_to, thread, depth, quoted`` and ``formatted``, the turn in chat layout without its quotes.

    Null text gives an empty turn and a null role the role ``unknown``; rows of one (conversation, turn) share their links; an
    empty table gives an empty result; other columns are kept, and new names that clash get underscores.
    """
    names = fresh(messages, "reply_to", "thread", "depth", "quoted", "formatted", "c", "t")
    reply_to, thread, depth, quoted, formatted, c, t = names
    tree = threads(links(messages, conv, turn, text)).select(F.col("conv_id").alias(c), F.col("turn").alias(t), F.col("reply_to").alias(reply_to), F.col("thread").alias(thread), F.col("depth").alias(depth), F.col("quoted").alias(quoted))
    body = F.when(F.col(text).rlike("(?md)" + MARK), once(passages(F.col(text)), own_text)).otherwise(F.coalesce(F.col(text), F.lit("")))
    laid = F.concat(F.lit(TURN[0]), F.coalesce(F.col(role), F.lit("unknown")), F.lit(TURN[1]), body, F.lit(TURN[2]))
    joined = messages.join(tree, (F.col(conv) == F.col(c)) & (F.col(turn) == F.col(t)), "left").drop(c, t)
    return joined.withColumns({thread: F.coalesce(F.col(thread), F.col(turn)), depth: F.coalesce(F.col(depth), F.lit(0).cast("long")), quoted: F.coalesce(F.col(quoted), F.lit(0).cast("long")), formatted: laid})


#: The same rows for DuckDB, with a recursive walk up the replies.
ORACLE = r"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
lines AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM raw),
signs AS (SELECT id, i, line, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS sign FROM lines),
levels AS (SELECT id, i, length(sign) - length(replace(sign, '>', '')) AS level, substr(line, length(sign) + 1) AS body FROM signs),
runs AS (SELECT *, sum(step) OVER (PARTITION BY id ORDER BY i) AS g FROM (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY i) THEN 1 ELSE 0 END AS step FROM levels)),
parts AS (SELECT id, g, level, string_agg(body, chr(10) ORDER BY i) AS body FROM runs GROUP BY id, g, level),
own AS (
  SELECT id, max(level) AS deepest, regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY g) FILTER (level = 0), ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body
  FROM parts GROUP BY id),
bodies AS (SELECT id, level, body FROM parts UNION ALL SELECT id, 0, body FROM own),
units AS (
  SELECT DISTINCT id, level, trim(regexp_replace(lower(piece), '\s+', ' ', 'g')) AS plain
  FROM (SELECT id, level, unnest(list_concat([body], regexp_split_to_array(body, '\n[ \t]*\n'))) AS piece FROM bodies)),
named AS (SELECT conv_id, turn, level, plain FROM units JOIN raw USING (id) WHERE plain <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
origin AS (SELECT conv_id, plain, min(turn) AS first FROM named WHERE level = 0 GROUP BY 1, 2),
link AS (SELECT n.conv_id, n.turn, level, max(first) AS to_ FROM named n JOIN origin o ON n.conv_id = o.conv_id AND n.plain = o.plain AND first < n.turn WHERE level > 0 GROUP BY 1, 2, 3),
parent AS (SELECT conv_id, turn, arg_min(to_, level) AS reply_to, count(*) AS quoted FROM link GROUP BY 1, 2),
walk AS (
  SELECT conv_id, turn, reply_to AS place, CAST(1 AS BIGINT) AS depth FROM parent
  UNION ALL SELECT w.conv_id, w.turn, p.reply_to, w.depth + 1 FROM walk w JOIN parent p ON w.conv_id = p.conv_id AND w.place = p.turn),
roots AS (SELECT conv_id, turn, min(place) AS thread, max(depth) AS depth FROM walk GROUP BY 1, 2)
SELECT raw.conv_id, raw.turn, role, reply_to, coalesce(thread, raw.turn) AS thread, coalesce(depth, 0) AS depth, coalesce(quoted, 0) AS quoted,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || CASE WHEN deepest > 0 THEN body ELSE t END || '<|end|>' || chr(10) AS formatted
FROM raw JOIN own USING (id) LEFT JOIN parent p ON raw.conv_id = p.conv_id AND raw.turn = p.turn LEFT JOIN roots r ON raw.conv_id = r.conv_id AND raw.turn = r.turn
"""
