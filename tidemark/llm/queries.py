"""The registered queries of the subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, collocations, jaccard, langid, lexical, mixing, pii, posunlabelled, quality, quotes, tokenfiles, topk, toxicity
from tidemark.llm.columns import crc_of_id
from tidemark.session import scratch_path

Builder = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def builders() -> dict[str, Builder]:
    return dict(BUILDERS)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op8_mix", mixing.ORACLE)
def op8_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    manifest = tokenfiles.write(table(spark, sf, "documents"), scratch_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tokenfiles.checksums(spark, manifest)


@register("op10_quality")
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op6_bpe")
def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op3_pii")
def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.annotate(docs, pii.fit(docs)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@register("op4_language")
def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "lang_pred", "score")


@register("op1_topk", topk.ORACLE)
def op1_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.topk(table(spark, sf, "embeddings"), lambda i: i % 100 == 0)


@register("op9_chat", quotes.ORACLE)
def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.conversations(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "quoted", "formatted")


@register("op2_ngram_join", jaccard.ORACLE)
def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents"))


@register("op11_search", lexical.ORACLE)
def op11_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op13_collocations", collocations.ORACLE)
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@register("op12_quality")
def op12_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = posunlabelled.score(docs, posunlabelled.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
