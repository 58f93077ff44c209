"""From raw documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import decontaminate, lines, minhash, mixing, quality
from quillmark.llm.common import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored too; an empty table stays empty.
    As in all stages, columns beyond those of documents are dropped, and repeated rows share a fate."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left; n_chars follows the text. Null texts
    and rows without doc_id stay as they are."""
    out = lines.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; rows without doc_id and without words all do."""
    return minhash.keep_one(docs, size=5, percent=80).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, with or without doc_id; null and empty texts stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents of which it takes nothing go."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage), ("line dedup", line_stage), ("near-duplicate documents", near_stage),
    ("benchmark decontamination", benchmark_stage), ("mixing to target weights", mixing_stage),
]
#: A trained classifier and seeded hashing are not SQL; tests hold the stages after it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{top}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
