"""The totals as a Structured Streaming query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandtally.operators.flagstat import counters, merge
from strandtally.shared import new_path


def start_totals(records: DataFrame, name: str) -> StreamingQuery:
    """Keep the totals of a stream in the memory table ``name``; the state is one row."""
    stream = counters(records).writeStream.outputMode("complete").format("memory").queryName(name)
    return stream.option("checkpointLocation", new_path(records.sparkSession, "stream")).trigger(availableNow=True).start()


def stream_totals(records: DataFrame) -> DataFrame:
    """Run a stream over all it has now, and give the totals; an error in the stream is raised."""
    name = f"totals_{uuid.uuid4().hex}"
    query = start_totals(records, name)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return records.sparkSession.table(name)


def drain(records: DataFrame, folder: str, checkpoint: str) -> int:
    """Read all that a stream has now, in runs with ``availableNow``, and keep each batch's totals under ``folder``; gives the number of batches.

    A source that limits what it offers at a time is asked again until it has no more. A batch that runs again writes
    the same place, so ``drained`` counts each record once; a later call with the same checkpoint goes on from there.
    """
    done = 0

    def keep(batch: DataFrame, number: int) -> None:
        counters(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    while True:
        query = records.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        batches = sum(p.numInputRows > 0 for p in query.recentProgress)
        if not batches:
            return done
        done += batches


def drained(spark: SparkSession, folder: str) -> DataFrame:
    """The totals of all batches that ``drain`` has kept."""
    return merge(spark.read.parquet(folder))
