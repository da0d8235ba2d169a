"""A corpus from raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.llm.decontam import decontaminate
from strandtally.files import delete
from strandtally.llm.language_id import UNKNOWN, identify, learn
from strandtally.llm.line_dedup import LineIndex
from strandtally.llm.near_dup import near_duplicate_groups
from strandtally.llm.packing import byte_bpe_path, pack_documents
from strandtally.shared import new_path, scratch

#: Cosine below which a text resembles no language.
LEAST_SCORE = 0.15
BENCHMARK_ITEM_WORDS = 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without letters or like none of them go."""
    judged = docs.withColumn("__language", identify(docs, learn(docs)))
    return judged.where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents have too; those that lose all their text go."""
    out = LineIndex.build(docs).apply(docs).where((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, and all that have no id."""
    groups = near_duplicate_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hit = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=BENCHMARK_ITEM_WORDS).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return pack_documents(docs, byte_bpe_path(), end_id=1)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Tokenization cannot be written in SQL; tests/llm/test_pipeline_brute.py compares run() with a plain version of each stage, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's tables are deleted when its result is written, and that when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
