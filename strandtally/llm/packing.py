"""Harmonic packing of token sequences.

Documents are cut into pieces whose lengths are reciprocals of the capacity: whole capacities
first, then, while r ids remain, ``capacity // k`` ids for the smallest k with ``capacity / k <= r``
(about four pieces a document). A class is one such length s, and every bin of a class holds
exactly ``capacity // s`` pieces, side by side, so bins are nearly full and a piece's place follows
from its number within the class alone.

Workers number the pieces of each class on their own. The counts of (worker, class) are summed up
in order of the workers, which turns these numbers into numbers over all workers without moving
any piece. What is left over in each class (fewer pieces than one bin holds, so fewer than
``capacity * (ln(capacity) + 3)`` in all, however large the input) is packed first-fit decreasing.

Cases: null text is empty, and its document is the end id alone; equal rows are packed each on
their own; null ids stay; extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.llm.encode import encoder
from strandtally.llm.textscan import give_back, pieces, take_turn
from strandtally.shared import materialize


@functools.lru_cache(maxsize=65536)
def piece_lengths(n: int, capacity: int) -> list[int]:
    """How a document of n ids is cut."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out


def cut_documents(docs: DataFrame, doc_col: str, text_col: str, tokenizer: str, spaced: bool, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """One row per piece, with its number ``ord`` within its class and worker."""

    def run(batches):
        take_turn("encoder", encoder.cache_clear)
        worker, seen, encode = TaskContext.get().partitionId(), Counter(), encoder(tokenizer, spaced).encode
        for batch in batches:
            for part in pieces(batch, 4096):
                rows, which, ids = [], [], []
                for i, body in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    raw = np.append(body, np.uint32(end_id))
                    total, start = len(raw), 0
                    for length in piece_lengths(total, capacity):
                        own = raw[start : start + length]
                        which.append(i)
                        rows.append((start, length, zlib.crc32(own), total, seen[length]))
                        ids.append(own.astype(np.int32) if keep_ids else None)
                        seen[length] += 1
                        start += length
                values = np.array(rows, np.int64).reshape(-1, 5)
                doc = part.column(0).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, *[pa.array(values[:, j]) for j in range(5)], pa.array([worker] * len(rows), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ord", "worker", "ids"])
        give_back()

    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ord long, worker long, ids array<int>")


def _first_fit(capacity: int):
    """First fit, longest first, over the left-over pieces."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.argsort(-lengths, kind="stable")
        free: list[int] = []
        bins, offsets, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), {}
        for i in order:
            n = int(lengths[i])
            b = next((b for b in range(first.get(n, 0), len(free)) if free[b] >= n), len(free))
            if b == len(free):
                free.append(capacity)
            first[n] = b
            bins[i], offsets[i] = b, capacity - free[b]
            free[b] -= n
        table = table.drop_columns(["bin", "offset"])
        return table.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets))

    return run


def harmonic_pack(cut: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces (rows of ``cut``) that carry ``length``, ``worker`` and ``ord``."""
    counts = cut.groupBy("length", "worker").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("length")
    before = by_class.orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("l"), F.col("worker").alias("w"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(by_class).alias("all"))
    fit = F.expr(f"{capacity} div length")
    numbered = cut.join(base, (F.col("length") == F.col("l")) & (F.col("worker") == F.col("w"))).withColumn("ord", F.col("ord") + F.col("base")).withColumn("bin", F.floor(F.col("ord") / fit)).withColumn("offset", (F.col("ord") % fit) * F.col("length"))
    numbered = materialize(numbered.withColumn("full", F.col("ord") < F.floor(F.col("all") / fit) * fit).drop("l", "w", "base", "all", "ord", "worker"), "packing")
    # class bins are told apart by their length, the first-fit bins have 0 in its place
    name = lambda kind: (F.col("bin") * (capacity + 1) + kind).cast("long").alias("sequence_id")
    columns = [c for c in numbered.columns if c not in ("bin", "offset", "full")]
    full = numbered.where("full").select(*columns, name(F.col("length")), F.col("offset").cast("long").alias("offset"))
    rest = numbered.where("not full").drop("full")
    rest = rest.groupBy().applyInArrow(_first_fit(capacity), rest.schema)
    return full.unionByName(rest.select(*columns, name(F.lit(0)), F.col("offset").cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_col: str = "doc_id", text_col: str = "text", spaced: bool = True, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    cut = materialize(cut_documents(docs, doc_col, text_col, tokenizer, spaced, end_id, capacity, keep_ids), "pieces")
    out = harmonic_pack(cut, capacity)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that kept their ids; at most ``capacity`` ids a row."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe_path(), end_id=1)
