"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.shared import materialize

SALTS = 32


def with_group_min(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of each ``key``; a hot key is spread over SALTS tasks.

    The minimum is taken per (key, salt) first; at most SALTS rows of a key meet after that, and
    rows join their own (key, salt) only.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(key, "__salt").agg(F.min(value).alias("__min"))
    least = part.select(F.col(key).alias("__key"), F.col("__salt").alias("__slot"), F.min("__min").over(Window.partitionBy(key)).alias(out))
    return salted.join(least, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__slot"))).drop("__salt", "__key", "__slot")


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: str, seen: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with a small part of ``table`` for each key; the rows of a hot key are dealt out over SALTS tasks by ``by``.

    The table's rows meet the (key, salt) pairs that occur first. These are taken from ``seen``, if given, which has all the keys
    and ``by`` of ``rows`` and is cheaper to read.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int").alias("__salt")
    few = (rows if seen is None else seen).select(*keys, salt).distinct().join(table, keys)
    return rows.select("*", salt).join(few, [*keys, "__salt"]).drop("__salt")


def with_group_count(rows: DataFrame, key: str, by: str, out: str) -> DataFrame:
    """``rows`` with the number of rows of each ``key``, counted by salt first."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(key, "__salt").agg(F.count("*").alias("__n"))
    total = part.select(key, "__salt", F.sum("__n").over(Window.partitionBy(key)).alias(out))
    return salted.join(total, [key, "__salt"]).drop("__salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: tie each larger neighbour to the smallest of a node's neighbourhood. Small star: tie the node and its smaller neighbours to the smallest of these."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = with_group_min(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        near = with_group_min(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "u", "v", "m")
        seen = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return seen.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node in ``edges`` (columns u, v); root is the smallest node reached.

    A node that is its own root has no row. Rounds go on until the edges are stars; each is
    written to the shared folder, so a lost executor costs one round at most.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    while not _stars(now):
        now = materialize(_star(_star(now, large=True), large=False), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root at most, which is no node of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("root").alias("root")).where("tied > 1 OR tied > 0 AND root > 0")
    return odd.limit(1).count() == 0
