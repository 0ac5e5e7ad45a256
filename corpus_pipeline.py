"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing to weights, shards.

run() writes each stage's rows as Parquet in the shared folder and reads them back as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from narrata.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from narrata.llm.common import DOCUMENT, table
from narrata.operators.lineage import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality rules keep."""
    return quality_rules.filter_documents(docs).select(*DOCUMENT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: one document of each group of near duplicates."""
    return near_dedup.filter_documents(docs).select(*DOCUMENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that hold no benchmark item."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents as often, and with the words, that the mix takes."""
    return mixing.Mix(docs).documents().select(*DOCUMENT)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: documents with size, shard and slot."""
    return sharding.assign(docs.select(*DOCUMENT), n=16)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Pseudorandom mixing is no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; null and empty tables pass through as empty results.

    A stage's rows are deleted once the next stage's are written; the last ones are the result and stay.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
