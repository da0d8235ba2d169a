"""Anchors, spans, batches and offsets as relations.

Virtual offsets are packed (``compressed << 16 | within``); every relation carries a ``file_id``
and all windows are partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.shared import materialize


def anchors(ends: DataFrame, entries: DataFrame) -> DataFrame:
    """(file_id, anchor_id, packed): first record, the entries strictly between, end of data; each once.

    ``ends`` has (file_id, first_record, data_end), ``entries`` (file_id, packed).
    """
    inner = entries.where("packed <> 0").join(ends, "file_id").where("packed > first_record AND packed < data_end").select("file_id", "packed")
    edges = ends.select("file_id", F.explode(F.array("first_record", "data_end")).alias("packed"))
    by_file = Window.partitionBy("file_id").orderBy("packed")
    return inner.unionByName(edges).distinct().select("file_id", (F.row_number().over(by_file) - 1).cast("long").alias("anchor_id"), "packed")


def span_bounds(anchored: DataFrame) -> DataFrame:
    """(file_id, span_id, span_start, span_end): each span ends where the next anchor is."""
    by_file = Window.partitionBy("file_id").orderBy("packed")
    spans = anchored.select("file_id", F.col("anchor_id").alias("span_id"), F.col("packed").alias("span_start"), F.lead("packed").over(by_file).alias("span_end"))
    return spans.where("span_end IS NOT NULL")


def check_spans(spans: DataFrame) -> DataFrame:
    """Spans that are empty or do not begin where the one before ends."""
    before = F.lag("span_end").over(Window.partitionBy("file_id").orderBy("span_start"))
    return spans.withColumn("before", before).where("span_end <= span_start OR before <> span_start")


def span_windows(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """Each span with the index windows that begin at it (repeats kept); null where none does."""
    starts = entries.select("file_id", F.col("packed").alias("span_start"), "ref_id", "window_start")
    return spans.join(starts, ["file_id", "span_start"], "left").select("file_id", "span_id", "span_start", "ref_id", "window_start")


def member_positions(members: DataFrame) -> DataFrame:
    """Members with the inflated bytes before each of them in its file (``position``)."""
    before = Window.partitionBy("file_id").orderBy("compressed_offset").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("position", F.coalesce(F.sum("uncompressed_len").over(before), F.lit(0)).cast("long"))


def anchor_members(anchored: DataFrame, positioned: DataFrame) -> DataFrame:
    """(file_id, packed, compressed_offset, within, position) of anchors that lie in a member, with their inflated position."""
    split = anchored.select("file_id", "packed", F.shiftrightunsigned("packed", 16).alias("compressed_offset"), F.col("packed").bitwiseAND(F.lit(65535)).alias("within"))
    joined = split.join(positioned, ["file_id", "compressed_offset"]).where("within <= uncompressed_len")
    return joined.select("file_id", "packed", "compressed_offset", "within", (F.col("position") + F.col("within")).cast("long").alias("position"))


def prefix(positioned: DataFrame, cap: int) -> DataFrame:
    """Members of each file's front that inflate to at most ``cap`` bytes together."""
    return positioned.where(F.col("position") + F.col("uncompressed_len") <= cap)


def batch_plan(placed: DataFrame, cap: int) -> DataFrame:
    """(file_id, batch_start): greedy batches; each reaches to the furthest anchor within ``cap`` bytes.

    ``placed`` has (file_id, position), with distinct positions. Every anchor's successor is one range window; the
    chain from the first anchor is followed by doubling: after k rounds all batches of 2**k steps are
    known, so the number of joins grows with the logarithm of the number of batches. A span above the
    cap is an error.
    """
    reach = Window.partitionBy("file_id").orderBy("position").rangeBetween(0, cap)
    by_file = Window.partitionBy("file_id").orderBy("position")
    jump = placed.select("file_id", "position", F.max("position").over(reach).alias("next"), F.lead("position").over(by_file).alias("following"))
    if jump.where("next = position AND following IS NOT NULL").limit(1).count():
        raise ValueError(f"a span exceeds the configured {cap} bytes")
    jump = materialize(jump.where("following IS NOT NULL").select("file_id", "position", "next"), "jumps")
    reached = placed.groupBy("file_id").agg(F.min("position").alias("position"))
    while True:
        more = reached.join(jump, ["file_id", "position"]).select("file_id", F.col("next").alias("position"))
        grown = materialize(reached.unionByName(more).distinct(), "batches")
        if grown.count() == reached.count():
            break
        reached = grown
        twice = jump.select("file_id", F.col("position").alias("p"), F.col("next").alias("position")).join(jump, ["file_id", "position"], "left")
        # an anchor whose second step leads past the end stays where its first step led
        jump = materialize(twice.select("file_id", F.col("p").alias("position"), F.coalesce("next", "position").alias("next")), "jumps")
    last = placed.groupBy("file_id").agg(F.max("position").alias("last"))
    return reached.join(last, "file_id").where("position < last").select("file_id", F.col("position").alias("batch_start"))


def block_map(batches: DataFrame, positioned: DataFrame, last: DataFrame) -> DataFrame:
    """(file_id, batch_start, compressed_offset, src_start, src_end, batch_from, batch_to): which part of each member lies where in a batch.

    ``last`` has (file_id, data_end): where the last batch ends. Begins of members and of batches cut
    each file into pieces; a piece belongs to the last member and the last batch that began by then,
    so one sort of the cuts does what a join on overlapping intervals would.
    """
    null = F.lit(None).cast("long")
    cuts = positioned.where("uncompressed_len > 0").select("file_id", F.col("position").alias("at"), F.col("position").alias("member"), F.col("compressed_offset").alias("offset"), (F.col("position") + F.col("uncompressed_len")).alias("member_end"), null.alias("batch"))
    starts = batches.select("file_id", F.col("batch_start").alias("at"), null.alias("member"), null.alias("offset"), null.alias("member_end"), F.col("batch_start").alias("batch"))
    merged = cuts.unionByName(starts).groupBy("file_id", "at").agg(*[F.max(c).alias(c) for c in ("member", "offset", "member_end", "batch")])
    by_file = Window.partitionBy("file_id").orderBy("at")
    so_far = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = merged.select("file_id", "at", F.lead("at").over(by_file).alias("next"), *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("member", "offset", "member_end", "batch")])
    pieces = pieces.join(last, "file_id").withColumn("to", F.least("member_end", "data_end", F.coalesce("next", "data_end"))).where("batch IS NOT NULL AND member IS NOT NULL AND to > at")
    return pieces.select("file_id", F.col("batch").alias("batch_start"), F.col("offset").alias("compressed_offset"), (F.col("at") - F.col("member")).alias("src_start"), (F.col("to") - F.col("member")).alias("src_end"), (F.col("at") - F.col("batch")).alias("batch_from"), (F.col("to") - F.col("batch")).alias("batch_to"))


def translate(offsets: DataFrame, mapped: DataFrame) -> DataFrame:
    """(file_id, packed, batch_start, batch_offset): a virtual offset's place in its batch; the first place if it has several, null if none."""
    split = offsets.select("file_id", "packed", F.shiftrightunsigned("packed", 16).alias("compressed_offset"), F.col("packed").bitwiseAND(F.lit(65535)).alias("within")).distinct()
    fits = split.join(mapped, ["file_id", "compressed_offset"]).where("within BETWEEN src_start AND src_end")
    place = fits.groupBy("file_id", "packed").agg(F.min(F.struct("batch_start", (F.col("batch_from") + F.col("within") - F.col("src_start")).alias("batch_offset"))).alias("m"))
    return split.select("file_id", "packed").join(place, ["file_id", "packed"], "left").select("file_id", "packed", "m.batch_start", "m.batch_offset")
