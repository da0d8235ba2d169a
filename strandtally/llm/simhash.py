"""SimHash fingerprints and their near-duplicate groups, found with pivot distance tables.

A text is lower-cased (A-Z), cut at white space into words, and every run of ``shingle`` words is
hashed with XXH64 (seed 42); fewer words are one shingle. A fingerprint bit is set if it is set in
over half of the hashes. Texts without words have fingerprint zero.

Equal fingerprints are one class. Classes link at ``radius`` or fewer differing bits:

1. Each class gets its distances to ``PIVOTS`` fixed reference fingerprints. By the triangle
   inequality no coordinate of two linked classes differs by more than ``radius``.
2. The 64 bits form ``radius + 2`` blocks; linked classes agree on two of them at least, so each
   pair of blocks is a key. In keys of up to ``FEW`` classes all pairs meet.
3. In larger keys the pivot table chooses who meets: the first ``AXES`` coordinates, in steps of
   ``2 * radius + 1``, make cells; a class lives in one and visits those that a linked class may live in
   (two an axis at most), and classes meet those that live where they visit. Most pairs of a key never meet.
4. Of the pairs that meet, those with any coordinate difference over ``radius`` are discarded by the
   pivot table; the others are verified on the fingerprints.
5. Cells where more than ``CROWD`` classes live, all alike to every pivot, would give too many links. There each class is
   tied to all fingerprints at one bit's distance instead: two classes have such a fingerprint
   (or one of the two itself) in common exactly if they differ in at most two bits. That is exact
   and takes 65 rows a class. (With a radius other than 2, no cell counts as crowded.)

Components of the links give ``component_id``, the smallest id reachable.

Cases: null text is empty; rows with the same id are one document with several fingerprints and
tie these together; rows with a null id get no component; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandtally.llm.components import SALTS, connected_components, salted_join, with_group_min
from strandtally.llm.line_dedup import LOWER
from strandtally.shared import materialize

SEED = 42
PIVOTS = 24
FEW = 64
AXES = 6
CROWD = 48


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_col].dataType.simpleString()}, fp long")


def pivots() -> list[int]:
    """Reference fingerprints, as signed integers: hashes of 0, 1, 2, ..."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), SEED)).astype(np.int64)) for i in range(PIVOTS)]


def pivot_table(classes: DataFrame) -> DataFrame:
    """``classes`` (column fp) with ``d``: the distance to each pivot."""
    return classes.withColumn("d", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()]))


def block_keys(radius: int) -> list:
    """A column for each pair of blocks, holding the bits of both and the pair's number."""
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(a | b))).alias("bits")) for i, (a, b) in enumerate(itertools.combinations(masks, 2))]


def cell_of(d: Column, radius: int) -> Column:
    """The cell of the pivot table in which a class lives."""
    return F.array(*[F.floor(d[i] / (2 * radius + 1)).cast("int") for i in range(AXES)])


def visited_cells(d: Column, radius: int) -> Column:
    """The cells in which classes within the radius may live."""
    def along(axis: Column):
        return lambda c: F.transform(axis, lambda x: F.concat(c, F.array(x)))

    cells = F.array(F.array().cast("array<int>"))
    for i in range(AXES):
        axis = F.array_distinct(F.array(*[F.floor((d[i] + F.lit(by)) / (2 * radius + 1)).cast("int") for by in (-radius, radius)]))
        cells = F.flatten(F.transform(cells, along(axis)))
    return cells


def near_pivots(d: str, e: str, radius: int) -> Column:
    """Whether no coordinate differs by more than the radius."""
    return reduce(lambda a, b: a & b, [F.abs(F.col(d)[i] - F.col(e)[i]) <= radius for i in range(PIVOTS)])


def meetings(keyed: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (fp, d, fp2, d2) that meet, and the classes (fp) of crowded cells; ``keyed`` has (k, bits, fp, d)."""
    shared = materialize(keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    met = salted_join(keyed, shared, ["k", "bits"], "fp")
    few = materialize(met.where(F.col("n") <= FEW).drop("n"), "simhash-few")
    other = few.select("k", "bits", F.col("fp").alias("fp2"), F.col("d").alias("d2"))
    pairs = few.join(other, ["k", "bits"]).where("fp < fp2").select("fp", "d", "fp2", "d2")

    many = met.where(F.col("n") > FEW).select("k", "bits", "fp", "d")
    homes = many.withColumn("cell", cell_of(F.col("d"), radius))
    lived = materialize(homes.groupBy("k", "bits", "cell").agg(F.count("*").alias("lived")), "simhash-cells")
    visits = materialize(salted_join(many.withColumn("cell", F.explode(visited_cells(F.col("d"), radius))), lived, ["k", "bits", "cell"], "fp"), "simhash-visits")
    crowd = CROWD if radius == 2 else 1 << 62
    lives = salted_join(homes, lived, ["k", "bits", "cell"], "fp").where(F.col("lived") <= crowd).select("k", "bits", "cell", F.col("fp").alias("fp2"), F.col("d").alias("d2"))
    others = visits.where(F.col("lived") <= crowd).join(lives, ["k", "bits", "cell"]).where("fp < fp2").select("fp", "d", "fp2", "d2")
    # whoever lives in a cell visits it too
    return pairs.union(others), visits.where(F.col("lived") > crowd).select("fp").distinct()


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect exactly the classes within ``radius`` bits of each other.

    ``classes`` has distinct fingerprints ``fp``. Links inside crowded cells go over a smallest member
    of each neighbourhood instead of all pairs.
    """
    keyed = materialize(pivot_table(classes.select("fp")).select("fp", "d", F.explode(F.array(*block_keys(radius))).alias("key")).select("fp", "d", "key.k", "key.bits"), "simhash-keys")
    met, crowded = meetings(keyed, radius)
    edges = met.where(near_pivots("d", "d2", radius)).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius).select(F.col("fp").alias("u"), F.col("fp2").alias("v"))
    if radius != 2:
        return edges
    balls = crowded.select("fp", F.explode(F.concat(F.array("fp"), F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]))).alias("centre"))
    tied = with_group_min(balls, "centre", "fp", "least").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    return edges.union(tied)


def simhash_components(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps = materialize(fingerprints(docs, doc_col, text_col, shingle), "simhash-fps")
    known = fps.where("doc_id is not null")
    classes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    edges = links(classes, radius)
    versions = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.collect_set("fp").alias("all")).where("a <> b")
    edges = edges.union(versions.select(F.col("a").alias("u"), F.explode("all").alias("v")).where("u <> v"))
    roots = connected_components(edges)
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(with_group_min(rooted, "root", "least", "component_id").select("fp", "component_id"), "simhash-named")
    # a class of many copies is spread over slots; only slots that occur get the class's row
    fps = fps.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    slots = fps.select(F.col("fp").alias("fp2"), F.col("slot").alias("slot2")).distinct().join(named.withColumnRenamed("fp", "fp2"), "fp2")
    out = fps.join(slots, (F.col("fp") == F.col("fp2")) & (F.col("slot") == F.col("slot2")), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
