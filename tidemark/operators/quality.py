"""Selection, freshness, completeness, contract and schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import labels as L
from tidemark.operators.signals import from_end, pct_of
from tidemark.operators.text import let


def lookback(obs: DataFrame, as_of: str, days: Column | int, time: str = "obs_date") -> DataFrame:
    """Rows no older than ``days`` before ``as_of``."""
    start = F.date_sub(F.lit(as_of).cast("date"), days)
    return obs.where((F.col(time) >= start) & (F.col(time) <= F.lit(as_of).cast("date")))


def frequency_days(frequency: Column, is_regime: Column, days: int = 182) -> Column:
    """Look-back of a series: 1825 days for regime series, at least 400 for slow ones, ``days`` otherwise."""
    return F.when(is_regime, 1825).when(frequency.isin("monthly", "quarterly"), max(days, 400)).otherwise(days)


def select_series(obs: DataFrame, ids: Sequence[str], key: str = "series_id") -> DataFrame:
    """Targeted pull; the list reaches the scan as a pushed-down filter."""
    return obs.where(F.col(key).isin(list(ids)))


def exclude(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``bad``."""
    return df.join(bad.select(*keys), list(keys), "left_anti")


def keep_categories(df: DataFrame, meta: DataFrame, categories: Sequence[str], key: str = "series_id") -> DataFrame:
    """Rows of series in the wanted categories."""
    return df.join(meta.where(F.col("category").isin(list(categories))).select(key), key, "left_semi")


def freshness(df: DataFrame, keys: Sequence[str], ts: str, as_of: str, fail_hours: int = 18, warn_days: int = 5, stale_days: int = 7) -> DataFrame:
    """Age of the newest row per key with its verdicts."""
    newest = df.groupBy(*keys).agg(F.max(F.col(ts).cast("timestamp")).alias("newest"))
    age = F.timestamp_diff("HOUR", F.col("newest"), F.lit(as_of).cast("timestamp"))
    return newest.select(
        *keys,
        age.alias("age_hours"),
        (age > fail_hours).alias("failed"),
        (age > warn_days * 24).alias("warned"),
        F.when(age > stale_days * 24, "STALE").otherwise("FRESH").alias("status"),
    )


def missing_keys(required: DataFrame, have: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Required keys that are absent or null."""
    return required.join(have.where(F.col(value).isNotNull()).select(*keys), list(keys), "left_anti")


def contract_gaps(expected: DataFrame, actual: DataFrame, variables: dict[str, Column], name: str = "name") -> DataFrame:
    """Expected names, with ``{variable}`` substituted, that do not exist."""
    filled = F.col("pattern")
    for key, col in variables.items():
        filled = F.replace(filled, F.lit("{" + key + "}"), col)
    return expected.select("*", filled.alias(name)).join(actual.select(name).distinct(), name, "left_anti")


def violations(df: DataFrame, rules: list[tuple[Column, str]], keep: Sequence[str]) -> DataFrame:
    """One row per broken rule."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in rules]))
    return df.select(*keep, F.explode(found).alias("violation"))


#: Words of a text that stands in for real content.
STUB_PHRASES = ("see thesis document", "see thesis doc", "see document")


@dataclass(frozen=True)
class Rule:
    """What a field of a nested record must be.

    ``kind`` is ``string``, ``array`` or ``object``. ``values`` are the allowed strings; ``filled`` forbids blank strings and
    empty arrays; ``fields`` are the rules of an object, or of every object in an array; ``stub`` names the inner field that must
    not hold a stub phrase, in an object or in an array of a single object; ``any_of`` names fields of which an object needs one.
    With ``of_class`` the rule holds for records of that class only, and ``present`` asks for no more than that the field exists.
    """

    name: str
    kind: str = "string"
    required: bool = True
    values: tuple[str, ...] = ()
    filled: bool = False
    fields: tuple[Rule, ...] = ()
    stub: str = ""
    any_of: tuple[str, ...] = ()
    of_class: str = ""
    present: bool = False


def _field(value: Column, name: str) -> Column:
    """A field of a variant; JSON's null is no value."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(~F.coalesce(F.is_variant_null(found), F.lit(True)), found)


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    named = ((schema == "STRING", "string"), (schema.startswith("ARRAY"), "array"), (schema.startswith("OBJECT"), "object"), (schema == "BOOLEAN", "boolean"))
    return L.case(*named, default="number")


def _stub(value: Column, inner: str) -> Column:
    text = F.lower(F.coalesce(F.try_variant_get(value, f"$.{inner}", "string"), F.lit("")))
    found = F.lit(False)
    for phrase in STUB_PHRASES:
        found = found | text.contains(phrase)
    return found


def _problems(value: Column, rules: Sequence[Rule], of_class: Column, prefix: Column) -> Column:
    """Array of what is wrong with an object, each with its path."""
    # A field is taken out of its record once, for all that is asked of it.
    return F.concat(*[let(_field(value, rule.name), partial(_field_problems, rule, of_class, prefix)) for rule in rules])


def _field_problems(rule: Rule, of_class: Column, prefix: Column, child: Column) -> Column:
    """Array of what is wrong with one field of an object."""

    def found_with(kind: Column) -> Column:
        path = F.concat(prefix, F.lit(rule.name))
        say = lambda words, path=path: F.concat(path, F.lit(f" {words}"))
        text = F.try_variant_get(child, "$", "string")
        typed = child.isNotNull() & (kind == rule.kind)
        found = []
        if rule.required:
            found.append(F.when(child.isNull(), say("is missing")))
        if not rule.present:
            found.append(F.when(child.isNotNull() & (kind != rule.kind), F.concat(say(f"must be {rule.kind}, got "), kind)))
        if rule.values:
            found.append(F.when(typed & ~text.isin(*rule.values), F.concat(say("is not a valid value: "), text)))
        members = F.coalesce(F.try_variant_get(F.when(typed, child), "$", "array<variant>"), F.array().cast("array<variant>")) if rule.kind == "array" else None
        if rule.filled:
            empty = F.size(members) == 0 if rule.kind == "array" else F.trim(text) == ""
            found.append(F.when(typed & empty, say("is empty")))
        if rule.stub:
            stands_in = (F.size(members) == 1) & _stub(F.get(members, F.lit(0)), rule.stub) if rule.kind == "array" else _stub(child, rule.stub)
            found.append(F.when(typed & stands_in, say("holds a placeholder")))
        if rule.any_of:
            neither = F.lit(True)
            for name in rule.any_of:
                inner = _field(child, name)
                blank = F.trim(F.coalesce(F.try_variant_get(inner, "$", "string"), F.lit("x"))) == ""
                hollow = F.coalesce(F.size(F.try_variant_get(inner, "$", "array<variant>")) == 0, F.lit(False))
                neither = neither & (inner.isNull() | blank | hollow)
            found.append(F.when(typed & neither, say("has neither " + " nor ".join(rule.any_of))))
        every = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        if rule.fields and rule.kind == "object":
            every = F.concat(every, F.when(typed, _problems(child, rule.fields, of_class, F.concat(path, F.lit(".")))).otherwise(F.array().cast("array<string>")))
        if rule.fields and rule.kind == "array":
            every = F.concat(every, F.flatten(F.transform(members, _member_problems(rule, path, of_class))))
        return F.when(of_class == rule.of_class, every).otherwise(F.array().cast("array<string>")) if rule.of_class else every

    return let(_kind(child), found_with)


def _member_problems(rule: Rule, path: Column, of_class: Column):
    """What is wrong with one object of an array."""

    def check(x: Column, i: Column) -> Column:
        at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        wrong = F.array(F.concat(at, F.lit(" must be object, got "), F.coalesce(_kind(x), F.lit("null"))))
        return let(_kind(x) == "object", lambda sound: F.when(F.coalesce(sound, F.lit(False)), _problems(x, rule.fields, of_class, F.concat(at, F.lit(".")))).otherwise(wrong))

    return check


def record_violations(df: DataFrame, record: str, rules: Sequence[Rule], of_class: Column, keep: Sequence[str]) -> DataFrame:
    """One row per broken rule of the nested records in the JSON column ``record``; text that is no object breaks one rule."""
    # Records are small beside the work on them, so they are dealt to all tasks and not by the size of their files.
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = df.select("*", F.try_parse_json(record).alias("_record"), F.coalesce(of_class, F.lit("")).alias("_class"))
    sound = F.coalesce(_kind(F.col("_record")) == "object", F.lit(False))
    found = F.when(sound, _problems(F.col("_record"), rules, F.col("_class"), F.lit(""))).otherwise(F.array(F.lit("record is no object")))
    return parsed.select(*keep, F.explode(found).alias("violation"))


def fidelity(source: DataFrame, parsed: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Item counts of a source and of what was parsed from it, with truncated items."""
    cut = F.col(text).endswith("...") | F.col(text).endswith("…")
    a = source.groupBy(*keys).agg(F.count("*").alias("n_source"))
    z = parsed.groupBy(*keys).agg(F.count("*").alias("n_parsed"), F.count(F.when(cut, 1)).alias("n_truncated"))
    both = a.join(z, list(keys), "full_outer").na.fill(0, ["n_source", "n_parsed", "n_truncated"])
    bad = (F.col("n_source") != F.col("n_parsed")) | (F.col("n_truncated") > 0)
    return both.select("*", bad.alias("mismatch"))


def eligibility(
    prices: DataFrame, key: str, time: str, price: str, volume: str, as_of: str, max_age: int = 7, min_volume: float = 10000.0
) -> DataFrame:
    """Reject assets whose last price is old or whose mean volume over the last 20 rows is too small."""
    w = Window.partitionBy(key)
    placed = prices.where(F.col(price).isNotNull()).select(
        key, time, price, volume, from_end([key], time).alias("_pos"), F.count("*").over(w).alias("_n")
    )
    card = placed.groupBy(key).agg(
        F.max(time).alias("last_date"),
        F.max(F.when(F.col("_pos") == 1, F.col(price))).alias("last_price"),
        F.avg(F.when(F.col("_pos") <= 20, F.col(volume))).alias("avg_volume"),
        F.max(F.when(F.col("_pos") == F.least(F.lit(22), F.col("_n")), F.col(price))).alias("_month"),
        F.max(F.when(F.col("_pos") == F.col("_n"), F.col(price))).alias("_first"),
    )
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_date"))
    reason = L.case((age > max_age, "stale"), (F.floor("avg_volume") < min_volume, "illiquid"), default="")
    return card.select(
        key,
        "last_date",
        "last_price",
        "avg_volume",
        pct_of(F.col("last_price") - F.col("_month"), F.col("_month")).alias("month_change_pct"),
        pct_of(F.col("last_price") - F.col("_first"), F.col("_first")).alias("window_change_pct"),
        reason.alias("reason"),
        (reason == "").alias("eligible"),
    )


def ambiguity_band(metric: Column, threshold: Column | float, pct: float = 10.0) -> Column:
    """Within ``pct`` percent of a threshold."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.abs(F.try_divide(metric, limit) - 1) <= pct / 100


def coordinate_consistency(regimes: DataFrame, eps: float = 0.15) -> DataFrame:
    """Whether each score's sign matches its label; scores near zero are exempt."""

    def fits(score: str, positive: Column) -> Column:
        s = F.col(score)
        return F.coalesce((F.abs(s) < eps) | (positive & (s > 0)) | (~positive & (s < 0)), F.lit(True))

    growth_up = F.col("regime").isin("Goldilocks", "Overheating")
    inflation_up = F.col("regime").isin("Overheating", "Stagflation")
    ample = F.col("liquidity_binary") == "loose"
    flags = regimes.select(
        "entity_id",
        "month",
        fits("growth_score", growth_up).alias("growth_ok"),
        fits("inflation_score", inflation_up).alias("inflation_ok"),
        fits("liquidity_score", ample).alias("liquidity_ok"),
    )
    return flags.select("*", (F.col("growth_ok") & F.col("inflation_ok") & F.col("liquidity_ok")).alias("consistent"))


def companions(docs: DataFrame, records: DataFrame, key: str, as_of: str, only: str | None = None) -> DataFrame:
    """Active documents without a companion record, or whose companion was not updated on the run date.

    ``only`` restricts the check to the documents of one ``producer``; a producer without documents is itself a problem.
    """
    asked = docs if only is None else docs.where(F.col("producer") == only)
    joined = asked.join(records, key, "left")
    missing = F.col("updated").isNull()
    problem = L.case((missing, "missing"), (F.col("updated") != as_of, "not updated"))
    found = joined.select(key, F.coalesce("record_class", "doc_class", F.lit("unknown")).alias("class"), problem.alias("problem"))
    found = found.where(F.col("problem").isNotNull())
    if only is None:
        return found
    known = asked.agg(F.count("*").alias("_n")).where("_n = 0")
    return found.unionByName(known.select(F.lit(None).cast(docs.schema[key].dataType).alias(key), F.lit("unknown").alias("class"), F.lit(f"unknown producer {only}").alias("problem")))


def forecast_sanity(forecasts: DataFrame, limit: float = 0.2, slack: float = 0.01, keys: Sequence[str] = ("entity_id", "horizon")) -> DataFrame:
    """Probabilities far from their base rate, and distributions that do not sum to one; ``keys`` name one distribution."""
    total = F.sum("prob").over(Window.partitionBy(*keys))
    return forecasts.select(
        "*",
        (F.abs(F.col("prob") - F.col("base_rate")) > limit).alias("far_from_base"),
        (F.abs(total - 1) > slack).alias("bad_total"),
    )


def collection_stats(fetched: DataFrame, source: str, failed: Column) -> DataFrame:
    """Items, failures and success rate per source and overall."""
    return fetched.rollup(source).agg(
        F.count("*").alias("n"),
        F.count(F.when(failed, 1)).alias("errors"),
        (F.avg(F.when(failed, 0.0).otherwise(100.0))).alias("success_pct"),
    ).select(F.coalesce(source, F.lit("all")).alias("source"), "n", "errors", "success_pct")
