"""What the files of a scan hold: their members, index entries and ends as relations, and what a scan of them covers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.functions import codecs
from strandtally.plans import spans as plans
from strandtally.sources import datasource


def _load(spark: SparkSession, source: str, paths: list[str], **options) -> DataFrame:
    return spark.read.format(source).option("paths", json.dumps(paths)).options(**options).load()


def members(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """(file_id, compressed_offset, compressed_len, uncompressed_len, is_eof) of all members; a file's id is its path."""
    return _load(spark, "bgzf", paths, **options).withColumnRenamed("path", "file_id")


def entries(spark: SparkSession, paths: list[str], index: dict[str, str] | None = None) -> DataFrame:
    """(file_id, ordinal, packed, ref_id, window_start) of the index entries, repeats kept."""
    beside = {datasource.default_index(p) if index is None else index[p]: p for p in paths}
    rows = _load(spark, "bai", list(beside))
    own = F.regexp_replace("path", r"\.bai$", "") if index is None else F.create_map(*[F.lit(x) for kv in beside.items() for x in kv])[F.col("path")]
    return rows.select(own.alias("file_id"), "ordinal", codecs.pack_offset(F.col("compressed"), F.col("within")).alias("packed"), "ref_id", "window_start")


def ends(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, reference_count, first_record, data_end): where each file's records begin and end."""
    rows = _load(spark, "bam_header", paths)
    return rows.select(F.col("path").alias("file_id"), "reference_count", codecs.pack_offset(F.col("first_compressed"), F.col("first_within")).alias("first_record"), codecs.pack_offset(F.col("data_end"), F.lit(0)).alias("data_end"))


def member_numbers(found: DataFrame) -> DataFrame:
    """Members with their number in the file, from 0."""
    by_file = Window.partitionBy("file_id").orderBy("compressed_offset")
    return found.withColumn("member", (F.row_number().over(by_file) - 1).cast("long"))


def numbered(rows: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """``rows`` (file_id, ...) with the members' numbers for their offsets in a column of virtual offsets."""
    own = numbers.select(F.col("file_id").alias("f2"), F.col("compressed_offset").alias("c2"), "member")
    joined = rows.join(own, (F.col("file_id") == F.col("f2")) & (codecs.offset_compressed(F.col(column)) == F.col("c2")))
    return joined.withColumn(column, codecs.pack_offset(F.col("member"), codecs.offset_within(F.col(column)))).drop("f2", "c2", "member")


def coverage(records: DataFrame, found: DataFrame, anchored: DataFrame) -> DataFrame:
    """Per file: records, record_bytes, spans, anchors, members, compressed_bytes, inflated_bytes, and whether the spans cover it.

    ``records`` are rows of the ``bam`` source, ``found`` of ``members``, ``anchored`` of ``plans.anchors``.
    """
    by_span = records.groupBy(F.col("path").alias("file_id"), "span_id").agg(F.count("*").alias("n"), F.sum(F.col("block_size") + 4).alias("bytes"))
    read = by_span.groupBy("file_id").agg(F.sum("n").alias("records"), F.sum("bytes").alias("record_bytes"), F.count("*").alias("spans"))
    held = found.groupBy("file_id").agg(F.count("*").alias("members"), F.sum("compressed_len").cast("long").alias("compressed_bytes"), F.sum("uncompressed_len").cast("long").alias("inflated_bytes"))
    cut = anchored.groupBy("file_id").agg(F.count("*").alias("anchors"))
    return cut.join(held, "file_id", "left").join(read, "file_id", "left").select("file_id", "records", "record_bytes", "spans", "anchors", "members", "compressed_bytes", "inflated_bytes", F.coalesce(F.col("spans") + 1 == F.col("anchors"), F.lit(False)).alias("complete"))


def file_coverage(spark: SparkSession, records: DataFrame, paths: list[str], index: dict[str, str] | None = None) -> DataFrame:
    """``coverage`` of a scan of these files."""
    return coverage(records, members(spark, paths), plans.anchors(ends(spark, paths), entries(spark, paths, index)))


def check_coverage(covered: DataFrame) -> None:
    """Raise if the spans of some file are not all its anchors make."""
    bad = [r.file_id for r in covered.where("not complete").limit(5).collect()]
    if bad:
        raise ValueError(f"spans do not cover: {', '.join(bad)}")


def metrics_coverage(metrics: DataFrame) -> DataFrame:
    """Per file, from a scan's own metrics: records, spans, anchors, members, bytes, and whether the spans cover it.

    A member that several splits share counts once, however the file is cut.
    """
    shared = ("members", "compressed_bytes", "inflated_bytes")
    sums = [F.sum(c).alias(c) for c in ("records", "spans", *shared, "index_reads")]
    found = metrics.groupBy(F.col("path").alias("file_id")).agg(F.count("*").alias("splits"), F.max("anchors").alias("anchors"), *sums)
    edges = metrics.select("path", F.explode("edges").alias("m")).select("path", F.lit(1).alias("members"), "m.*")
    again = edges.groupBy(F.col("path").alias("file_id"), "offset").agg(*[(F.sum(c) - F.first(c)).alias(c) for c in shared])
    again = again.groupBy("file_id").agg(*[F.sum(c).alias(f"{c}_again") for c in shared])
    found = found.join(again, "file_id", "left").withColumns({c: F.col(c) - F.coalesce(F.col(f"{c}_again"), F.lit(0)) for c in shared}).drop(*[f"{c}_again" for c in shared])
    return found.withColumn("complete", F.col("spans") + 1 == F.col("anchors"))


def stage_times(metrics: DataFrame) -> DataFrame:
    """(stage, total_s, longest_s, splits): what the stages of a scan took over all its splits."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_s").alias("s")) for s in datasource.STAGES])
    return metrics.select(F.explode(stages).alias("t")).groupBy("t.stage").agg(F.sum("t.s").alias("total_s"), F.max("t.s").alias("longest_s"), F.count("*").alias("splits"))


def throughput(logical_bytes: Column, seconds: Column) -> Column:
    """GB a second; null for no time."""
    return F.try_divide(logical_bytes, seconds * 1e9)


def campaign(runs: DataFrame) -> DataFrame:
    """Median, least and most seconds of repeated runs (name, seconds, logical_bytes), GB a second, and time against the fastest name."""
    by_name = runs.groupBy("name").agg(F.count("*").alias("runs"), F.median("seconds").alias("median_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.max("logical_bytes").alias("logical_bytes"))
    best = Window.partitionBy(F.lit(0))  # a row a name
    return by_name.select("name", "runs", "median_s", "min_s", "max_s", throughput(F.col("logical_bytes"), F.col("median_s")).alias("gb_per_s"), F.try_divide("median_s", F.min("median_s").over(best)).alias("ratio"))
