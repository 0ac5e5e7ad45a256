"""The queries opN_<name> of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import decontaminate, language_id, licenses, mixing, near_dedup, quality_model, quality_rules, sharding, token_counts, toxicity
from narrata.llm.common import shared_folder, table
from narrata.llm.oracles import oracle_sql  # noqa: F401


#: A document is called toxic, or of good quality, from this score on.
CUT = 0.3


def remainder(n: int) -> Column:
    """crc32 of the document's id as text, modulo n: tells rows that are held out from rows to learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.Mix(table(spark, folder, "documents")).taken()


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes(table(spark, folder, "documents")).drop("node")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs, language_id.fit(docs, remainder(3) != 1))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_model.fit(docs, table(spark, folder, "labels"), remainder(5) != 0)
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(table(spark, folder, "documents"), n=16)


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.containment(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).select(*quality_rules.RESULT)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    grammar = toxicity.fit(docs, table(spark, folder, "labels"), remainder(4) != 2)
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four batches: all documents inserted, the same batch once more, documents with an id divisible by 50
    deleted, and those with remainder 1 revised to capitals."""
    docs, text = table(spark, folder, "documents"), F.col("text")
    rollup = token_counts.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.commit("inserted", token_counts.inserts(docs))
    rollup.commit("deleted", token_counts.changed(docs.where("doc_id % 50 = 0"), "delete", old_text=text))
    rollup.commit("revised", token_counts.changed(docs.where("doc_id % 50 = 1"), "revise", old_text=text, new_text=F.upper(text)))
    return rollup.totals()


def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing,
        op2_near_dedup,
        op3_language_id,
        op4_quality_classifier,
        op5_sharding,
        op6_benchmark_decontamination,
        op7_quality_rules,
        op8_toxicity,
        op9_token_counts,
        op10_license_scan,
    )
    return {f.__name__: f for f in found}
