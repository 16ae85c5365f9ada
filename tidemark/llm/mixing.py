"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target share of all words by its weight; no target exceeds ``most`` times the source. A document is
taken ``copies`` times, as often as its whole source fits into the target, and once more if its hash lies below the
source's threshold. The threshold comes from sums of words by (source, hash digit): the digit where the running sum passes
the budget is the boundary, and only that bucket is summed again by its next digit. Thresholds are nested, so a larger
budget only adds documents; nothing is sorted, and a rerun gives the same choice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.columns import fresh, word_count
from tidemark.session import materialise

#: Fixed values of the default mix.
WEIGHTS = (5, 2, 1)
MOST = 3
#: A hash has ``DIGITS`` digits of ``BITS`` bits.
DIGITS, BITS = 5, 12


def key_hash(key: Column) -> Column:
    """60 bits of the MD5 digest of the key written as text; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` gets ``target, copies, budget``.

    Sources take the weights in turn by code point order, null last. A target is min(most * size, level * weight), with the
    level at which targets add up to the total: what stopping sources leave is shared again by weight. One row per source,
    so the windows here see sources, never documents.
    """
    scale = math.lcm(*weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    big = lambda c: c.cast("decimal(38,0)")
    by_cap = Window.orderBy(big(F.col("source_size")) * (F.lit(scale) / F.col("weight")).cast("int"), "rank")
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight.cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("place", F.row_number().over(by_cap))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    )
    below = big(F.col("cap")) * big(F.col("open")) > big(F.col("total") - F.col("before")) * big(F.col("weight"))
    ranked = ranked.withColumn("first", F.min(F.when(below, F.struct("place", (F.col("total") - F.col("before")).alias("rest"), "open"))).over(everything))
    target = F.when(F.col("place") >= F.col("first.place"), F.col("weight").cast("double") * F.col("first.rest").cast("double") / F.col("first.open").cast("double")).otherwise(F.col("cap").cast("double"))
    size = F.col("source_size").cast("double")
    copies = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    return ranked.withColumn("target", target).withColumn("copies", copies).select(
        "source", "source_size", "target", "copies", F.greatest(F.col("target") - F.col("copies") * size, F.lit(0.0)).alias("budget")
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: ``source, source_size, target, copies, upto``; a further copy goes to hashes of at most ``upto``.

    ``sized`` has ``source, size, hash``, one row per document. Each round reads the documents of the boundary buckets only
    and sums them by one more digit. Documents of one hash stand or fall together; the last one is taken if that comes nearer.
    """
    edge = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    edge = materialise(edge.withColumns({"prefix": F.lit(0).cast("long"), "sum_below": F.lit(0).cast("long"), "open": F.lit(True)}), "mix-edge")
    for level in range(1, DIGITS + 1):
        shift = BITS * (DIGITS - level)
        inside = sized.join(
            edge.where("open").select(F.col("source").alias("of"), F.col("prefix").alias("at")),
            F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("hash", shift + BITS) == F.col("at")),
        )
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("digit")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("digit")
        sums = sums.withColumn("upper", F.sum("words").over(run)).select(F.col("source").alias("of"), "digit", "upper", (F.col("upper") - F.col("words")).alias("lower"))
        found = (
            sums.join(edge.select("source", "sum_below", "budget"), F.col("source").eqNullSafe(F.col("of")))
            .where((F.col("sum_below") + F.col("upper")).cast("double") > F.col("budget"))
            .groupBy("of").agg(F.min(F.struct("digit", "lower", "upper")).alias("hit"))
        )
        edge = edge.join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        # A source whose documents all fit has no boundary: everything is taken.
        edge = edge.select(
            "source", "source_size", "target", "copies", "budget",
            F.when(F.col("open") & F.col("hit").isNotNull(), F.col("hit.digit")).otherwise(F.col("prefix")).alias("prefix"),
            (F.col("sum_below") + F.coalesce(F.when(F.col("open"), F.col("hit.lower")), F.lit(0))).alias("sum_below"),
            (F.col("open") & F.col("hit").isNotNull()).alias("open"),
            (F.coalesce(F.col("hit.upper"), F.lit(0)) - F.coalesce(F.col("hit.lower"), F.lit(0))).alias("last"),
        )
        edge = materialise(edge, "mix-edge")
    nearer = (F.col("sum_below") + F.col("last")).cast("double") - F.col("budget") < F.col("budget") - F.col("sum_below").cast("double")
    upto = F.when(~F.col("open"), F.lit((1 << BITS * DIGITS) - 1)).when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return materialise(edge.select("source", "source_size", "target", "copies", upto.cast("long").alias("upto")), "mix-upto")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``; ``copies`` is how often the mix takes the row.

    A null text has size 0; null is a source of its own; rows of one key are taken alike; an empty table gives an empty
    result; other columns, also ones with these names, are kept (the new ones then get underscores).
    """
    names = fresh(docs, "size", "source_size", "target", "copies", "of", "hash", "upto")
    size, source_size, target, copies, of, hashed, upto = names
    sized = docs.withColumns({size: word_count(F.col(text)), hashed: key_hash(F.col(key))})
    # Sizes are counted once for all rounds; the small table is a cut in the lineage.
    small = materialise(sized.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(hashed).alias("hash")), "mix-sizes")
    plan = thresholds(small, weights, most).select(
        F.col("source").alias(of), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("copies").alias(copies), F.col("upto").alias(upto)
    )
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col(of)))
    return joined.withColumn(copies, F.col(copies) + F.when(F.col(hashed) <= F.col(upto), 1).otherwise(0)).drop(of, hashed, upto)


#: The same rows by sorting, for DuckDB.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
capped AS (
  SELECT *, 3 * source_size AS cap, CAST([5, 2, 1][CAST((rk - 1) % 3 + 1 AS INT)] AS BIGINT) AS w FROM totals),
placed AS (
  SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open_
  FROM capped WINDOW o AS (ORDER BY source_size * (10 // w), rk)),
level_ AS (
  SELECT place AS p, total - before_ AS rest, open_ AS o FROM placed
  WHERE CAST(cap AS HUGEINT) * open_ > CAST(total - before_ AS HUGEINT) * w ORDER BY place LIMIT 1),
aimed AS (
  SELECT source, source_size,
         CASE WHEN place >= p THEN CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(o AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM placed LEFT JOIN level_ ON true),
fit AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM aimed),
budgets AS (SELECT *, greatest(target - copies * CAST(source_size AS DOUBLE), 0.0) AS budget FROM fit),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.copies, b.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS BIGINT) AS upper_,
         CAST(sum(s.size) OVER (PARTITION BY s.source, h) AS BIGINT) AS here
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       size * (copies + CASE WHEN upper_ <= budget OR (upper_ - here <= budget AND upper_ - budget < budget - (upper_ - here)) THEN 1 ELSE 0 END) AS taken
FROM run
"""
