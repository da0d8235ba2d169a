"""Totals by the spans and batches of files, and what is wrong with spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.functions import codecs
from strandtally.functions.flags import TOTALS
from strandtally.operators.flagstat import counters, merge


def by_span(records: DataFrame) -> DataFrame:
    """(file_id, span_id, the 32 totals, bytes) of rows of the ``bam`` source."""
    return counters(records, F.col("path").alias("file_id"), "span_id", also=[F.sum(F.col("block_size") + 4).alias("bytes")])


def batched(spans: DataFrame, cap: int) -> DataFrame:
    """Spans (file_id, span_id, bytes, ...) with their ``batch_id``: as many consecutive spans of a file as hold ``cap`` bytes together.

    Where a batch begins depends on all before it, so a file's spans, a row each, pass one task in order; it holds
    the batch at hand only. A span above the cap is an error.
    """
    names = spans.columns
    file_at, bytes_at = names.index("file_id"), names.index("bytes")

    def run(batches):
        file, batch, held = None, 0, 0
        for rows in batches:
            ids = []
            for own, size in zip(rows.column(file_at).to_pylist(), rows.column(bytes_at).to_pylist(), strict=True):
                if size > cap:
                    raise ValueError(f"{own}: a span exceeds the configured {cap} bytes")
                if own != file:
                    file, batch, held = own, 0, 0
                elif held + size > cap:
                    batch, held = batch + 1, 0
                held += size
                ids.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.int64())], [*names, "batch_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema) + ", batch_id long"
    return spans.repartition("file_id").sortWithinPartitions("file_id", "span_id").mapInArrow(run, schema)


def by_batch(records: DataFrame, cap: int) -> DataFrame:
    """(file_id, batch_id, the 32 totals, spans, bytes) of rows of the ``bam`` source."""
    rows = batched(by_span(records), cap)
    sizes = rows.groupBy("file_id", "batch_id").agg(F.count("*").alias("spans"), F.sum("bytes").alias("bytes"))
    return merge(rows.select("file_id", "batch_id", *TOTALS), "file_id", "batch_id").join(sizes, ["file_id", "batch_id"])


def broken_spans(records: DataFrame) -> DataFrame:
    """(file_id, span_id, status, description) of spans that their records break, in rows read with ``mode=permissive``."""
    bad = records.where("status <> 0")
    return bad.select(F.col("path").alias("file_id"), "span_id", "status", codecs.status_text(F.col("status")).alias("description"))


def first_broken(records: DataFrame) -> DataFrame:
    """Per file with broken spans: how many, and the first one with its status."""
    found = broken_spans(records).groupBy("file_id").agg(F.count("*").alias("broken"), F.min("span_id").alias("span_id"), F.min_by("status", "span_id").alias("status"))
    return found.withColumn("description", codecs.status_text(F.col("status")))
