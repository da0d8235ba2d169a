"""Registered queries of the alignment operators, and the same in SQL.

No alignment files come with the tables, so records are derived from ``lineitem``. The queries that read files
write them first, with Spark, from the derived records: one file for each reference, whose id stands
for the file. Members, index entries, anchors and spans are read back from these files. Offsets in compressed bytes depend on the
compressor, so results give members by their number in the file.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandtally.files import create, open_file
from strandtally.functions import codecs
from strandtally.functions.flags import COUNTERS, FAILED, NAMES, PASSED
from strandtally.operators import batches
from strandtally.operators import coverage as cover
from strandtally.operators import flagstat as ops
from strandtally.plans import spans as plans
from strandtally.shared import materialize, new_path
from strandtally.sources import datasource
from strandtally.sources.bam import write_bam
from strandtally.streaming.flagstat import drain, drained, stream_totals

REFERENCES = 25
_FIELDS = {
    "flag": "CAST((l_orderkey*7 + l_linenumber*131 + l_partkey*31 + l_suppkey*17) % 4096 AS INT)",
    "mapq": "CAST((l_partkey*13 + l_linenumber) % 61 AS INT)",
    "ref_id": "CAST(l_suppkey % 25 AS INT)",
    "next_ref_id": "CAST((l_partkey + l_linenumber) % 25 AS INT)",
    "pos": "CAST((l_orderkey*977 + l_partkey*31) % 400000000 AS INT)",
    "span_id": "CAST(l_orderkey % 512 AS BIGINT)",
    "batch_id": "CAST(l_orderkey % 16 AS BIGINT)",
}
_A = "a AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items()) + " FROM lineitem)"
RECORD, MEMBER_BYTES = 37, 8192
HEAD = 12 + sum(4 + len(f"chr{i + 1}") + 1 + 4 for i in range(REFERENCES))
_MEMBERS = f"""{_A},
r AS (SELECT ref_id AS file_id, CAST(pos // 16384 AS BIGINT) AS win, row_number() OVER (PARTITION BY ref_id ORDER BY pos) - 1 AS r FROM a),
c AS (SELECT file_id, count(*) * {RECORD} AS bytes, (count(*) * {RECORD} + {MEMBER_BYTES - 1}) // {MEMBER_BYTES} AS n FROM r GROUP BY file_id),
p AS (SELECT file_id, 0::BIGINT AS compressed_offset, {HEAD}::BIGINT AS uncompressed_len, 0::BIGINT AS position FROM c UNION ALL SELECT file_id, i + 1, least({MEMBER_BYTES}, bytes - i * {MEMBER_BYTES}), {HEAD} + i * {MEMBER_BYTES} FROM (SELECT file_id, bytes, unnest(range(0, n)) AS i FROM c)),
e AS (SELECT file_id, (1 + x // {MEMBER_BYTES}) << 16 | (x % {MEMBER_BYTES}) AS packed, file_id AS ref_id, win * 16384 AS window_start FROM (SELECT file_id, win, min(r) * {RECORD} AS x FROM r GROUP BY file_id, win)),
z AS (SELECT file_id, 65536::BIGINT AS first_record, (1 + n) << 16 AS data_end FROM c),
n AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY packed) - 1 AS anchor_id, packed FROM (SELECT e.file_id, packed FROM e JOIN z USING (file_id) WHERE packed > first_record AND packed < data_end UNION SELECT file_id, first_record FROM z UNION SELECT file_id, data_end FROM z))"""
CAP = 20_000
PREFIX = 40_000
#: References and positions of the region query.
REGION = (3, 7, 20), (500_000, 9_000_000)
#: Some windows have records whose sizes are too small, too large, or off by one.
_FALSE_SIZE = "CASE (pos // 16384) % 97 WHEN 3 THEN 7 WHEN 5 THEN 1048576 WHEN 11 THEN 32 ELSE 33 END"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*[F.expr(v).alias(k) for k, v in _FIELDS.items()])


class _Files:
    """Derived records as a folder of files, and what they hold, with references for files and numbers for members."""

    def __init__(self, spark: SparkSession, sf_dir: str, records: DataFrame | None = None, by_reference: bool = True):
        datasource.register(spark)
        self.spark = spark
        self.manifest = write_bam(alignments(spark, sf_dir) if records is None else records, new_path(spark, "bam"), REFERENCES, MEMBER_BYTES, by_reference)
        self.paths = [r.path for r in self.manifest.select("path").collect()]

    def read(self, source: str = "bam", columns: Sequence[str] = (), **options) -> DataFrame:
        """All columns of a source, or those of ``bam`` that are named."""
        reader = self.spark.read.schema(datasource.schema_of(*columns)) if columns else self.spark.read
        return reader.format(source).option("paths", json.dumps(self.paths)).options(maxCompressedBytes=1 << 20, **options).load()

    def stream(self) -> DataFrame:
        return self.spark.readStream.format("bam").schema(datasource.schema_of(*ops.FIELDS)).option("paths", json.dumps(self.paths)).option("maxCompressedBytes", 1 << 20).load()

    def by_ref(self, rows: DataFrame, column: str = "file_id") -> DataFrame:
        return rows.withColumn(column, F.regexp_extract(column, r"/ref-(-?\d+)-[^/]*$", 1).cast("int"))

    @cached_property
    def numbers(self) -> DataFrame:
        return materialize(cover.member_numbers(cover.members(self.spark, self.paths)), "members")

    @cached_property
    def members(self) -> DataFrame:
        rows = self.numbers.where("not is_eof").select("file_id", F.col("member").alias("compressed_offset"), F.col("uncompressed_len").cast("long").alias("uncompressed_len"))
        return materialize(self.by_ref(plans.member_positions(rows)), "members")

    @cached_property
    def entries(self) -> DataFrame:
        return materialize(self.by_ref(cover.numbered(cover.entries(self.spark, self.paths), "packed", self.numbers)), "entries")

    @cached_property
    def ends(self) -> DataFrame:
        rows = cover.ends(self.spark, self.paths)
        for column in ("first_record", "data_end"):
            rows = cover.numbered(rows, column, self.numbers)
        return self.by_ref(rows)

    @cached_property
    def anchors(self) -> DataFrame:
        return materialize(plans.anchors(self.ends.drop("reference_count"), self.entries), "anchors")

    @cached_property
    def placed(self) -> DataFrame:
        return materialize(plans.anchor_members(self.anchors, self.members).select("file_id", "position").distinct(), "placed")

    @cached_property
    def block_map(self) -> DataFrame:
        placed = self.placed
        last = placed.groupBy("file_id").agg(F.max("position").alias("data_end"))
        return plans.block_map(plans.batch_plan(placed, CAP), self.members, last)


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Files(spark, sf_dir).read(columns=ops.FIELDS)


def _totals_sql(relation: str = "a", keys: str = "") -> str:
    sums = ", ".join(f"CAST(coalesce(sum(CASE WHEN {c.predicate} AND {qc} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {c.name}_{name}" for c in COUNTERS for name, qc in (("pass", PASSED), ("fail", FAILED)))
    return f"SELECT {keys + ', ' if keys else ''}{sums} FROM {relation}" + (f" GROUP BY {keys}" if keys else "")


_TOTALS = f"WITH {_A} {_totals_sql()}"
_LONG = f"WITH {_A}, t AS ({_totals_sql()}) " + " UNION ALL ".join(f"SELECT '{n}' AS counter, {n}_pass AS qc_pass, {n}_fail AS qc_fail FROM t" for n in NAMES)


def _report_sql() -> str:
    def share(n: str, of: str) -> str:
        return f"CASE WHEN {of} = 0 THEN 'N/A' ELSE printf('%.2f%%', 100.0::DOUBLE * {n} / {of}) END"

    lines = []
    for c in COUNTERS:
        text = f"{c.name}_pass || ' + ' || {c.name}_fail || ' {c.label}'"
        if c.share_of:
            text += f" || ' (' || {share(c.name + '_pass', c.share_of + '_pass')} || ' : ' || {share(c.name + '_fail', c.share_of + '_fail')} || ')'"
        lines.append(f"SELECT {c.line} AS line_no, {text} AS line FROM t")
    return f"WITH {_A}, t AS ({_totals_sql()}) " + " UNION ALL ".join(lines)


def _precedence(s, d):
    kind = F.expr("CASE WHEN (flag & 256) <> 0 THEN 'secondary' WHEN (flag & 2048) <> 0 THEN 'supplementary' ELSE 'primary' END")
    return alignments(s, d).groupBy(kind.alias("class"), (F.col("flag").bitwiseAND(512) != 0).alias("failed")).agg(F.count("*").alias("n"))


def _diff_chromosome(s, d):
    return ops.counters(alignments(s, d), "ref_id", "next_ref_id").select("ref_id", "next_ref_id", *[f"{n}_{q}" for n in ("n_diffchr", "n_diffhigh") for q in ("pass", "fail")])


def _mapq_boundary(s, d):
    return ops.counters(alignments(s, d), "mapq").select("mapq", *[f"{n}_{q}" for n in ("n_diffchr", "n_diffhigh") for q in ("pass", "fail")])


def _line(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet")


def _virtual_offset_codec(s, d):
    packed = codecs.pack_offset(F.col("l_orderkey") * 4099, F.col("l_partkey") % 65536)
    return _line(s, d).select(packed.alias("packed")).select("packed", codecs.offset_compressed(F.col("packed")).alias("compressed"), codecs.offset_within(F.col("packed")).alias("within"))


def _bai_coordinates(s, d):
    a = alignments(s, d)
    return a.groupBy(codecs.coordinate(F.col("ref_id"), codecs.window_start(F.col("pos"))).alias("coordinate")).agg(F.count("*").alias("n"))


def _padded_sizes(s, d):
    return _line(s, d).groupBy(codecs.padded(F.col("l_partkey")).alias("padded")).agg(F.count("*").alias("n"))


def _capacity_classes(s, d):
    return _line(s, d).groupBy(codecs.capacity_class(F.col("l_partkey") - 5, F.lit(1500)).alias("capacity")).agg(F.count("*").alias("n"))


def _timestamp_delta(s, d):
    delta = codecs.tick_delta(F.col("l_orderkey") * 1237, F.col("l_partkey") * 7919, 16)
    return _line(s, d).select("l_orderkey", "l_partkey", delta.alias("ticks"), (delta * 0.5).cast("double").alias("ms"))


def _span_status(s, d):
    """The first span of each batch whose status is not zero, and what that means."""
    status = F.when(F.col("flag") % 7 == 0, F.col("flag") % 4).otherwise(0)
    found = alignments(s, d).groupBy("batch_id", "span_id").agg(F.max(status).alias("status")).where("status <> 0")
    first = found.groupBy("batch_id").agg(F.min(F.struct("span_id", "status")).alias("m"))
    return first.select("batch_id", "m.span_id", "m.status", codecs.status_text(F.col("m.status")).alias("description"))


def _span_windows(s, d):
    files = _Files(s, d)
    return plans.span_windows(plans.span_bounds(files.anchors), files.entries)


def _span_checks(s, d):
    """Per file: its spans, and those that are empty or leave a gap."""
    spans = plans.span_bounds(_Files(s, d).anchors)
    bad = plans.check_spans(spans).groupBy("file_id").agg(F.count("*").alias("bad"))
    return spans.groupBy("file_id").agg(F.count("*").alias("spans")).join(bad, "file_id", "left").select("file_id", "spans", F.coalesce("bad", F.lit(0).cast("long")).alias("bad"))


def _anchor_member_join(s, d):
    files = _Files(s, d)
    return plans.anchor_members(files.anchors, files.members)


def _translate(s, d):
    files = _Files(s, d)
    return plans.translate(files.anchors, files.block_map)


def _prefix(s, d):
    """Each file's front of at most PREFIX inflated bytes."""
    files = _Files(s, d)
    kept = files.by_ref(cover.members(s, files.paths, mode="prefix", maxUncompressedBytes=PREFIX))
    return kept.groupBy("file_id").agg(F.count("*").alias("members"), F.sum("uncompressed_len").cast("long").alias("uncompressed_bytes"))


def _vector_add(s, d):
    a, b = (F.col("l_orderkey") % 1000).cast("float"), (F.floor(F.col("l_partkey") / 10) % 1000).cast("float")
    return _line(s, d).select("l_orderkey", "l_partkey", (a + b).alias("total"))


def _field_decode(s, d):
    """Fields decoded from bytes by column expressions."""
    le = lambda n, size: F.expr(" || ".join(f"unhex(lpad(hex(({n} >> {8 * i}) & 255), 2, '0'))" for i in range(size)))
    a = alignments(s, d).select(F.concat(le("ref_id", 4), le("mapq", 1), le("flag", 2), le("next_ref_id", 4)).alias("raw"))
    return a.select(codecs.le_int(F.col("raw"), 0, 4).cast("int").alias("ref_id"), codecs.le_uint(F.col("raw"), 4, 1).cast("int").alias("mapq"), codecs.le_uint(F.col("raw"), 5, 2).cast("int").alias("flag"), codecs.le_int(F.col("raw"), 7, 4).cast("int").alias("next_ref_id"))


def _alignments_scan(s, d):
    return _read(s, d)


def _record_framing(s, d):
    """Per file: records, their bytes, spans, and spans whose records leave a gap."""
    files = _Files(s, d)
    by_span = files.read().groupBy(F.col("path").alias("file_id"), "span_id").agg(F.count("*").alias("n"), F.sum(F.col("block_size") + 4).alias("bytes"), F.max(F.col("record_offset") + F.col("block_size") + 4).alias("last"))
    return files.by_ref(by_span.groupBy("file_id").agg(F.sum("n").alias("records"), F.sum("bytes").alias("bytes"), F.count("*").alias("spans"), F.sum(F.when(F.col("last") == F.col("bytes"), 0).otherwise(1)).cast("long").alias("gaps")))


def _bam_header(s, d):
    return _Files(s, d).ends


def _bai_linear_index(s, d):
    """Every entry of every index, with the member and the place in it."""
    return _Files(s, d).entries


def _physical_endpoints(s, d):
    """Per file: its end, its index entries, and those that do not lie between its first record and its end."""
    files = _Files(s, d)
    inside = (F.col("packed") >= F.col("first_record")) & (F.col("packed") < F.col("data_end"))
    return files.entries.join(files.ends, "file_id").groupBy("file_id", "data_end").agg(F.count("*").alias("entries"), F.count_if(~inside).alias("outside"))


def _bgzf_members(s, d):
    """Per file: its members, end marker included, and what they inflate to."""
    files = _Files(s, d)
    return files.by_ref(cover.members(s, files.paths)).groupBy("file_id").agg(F.count("*").alias("members"), F.count_if("is_eof").alias("end_markers"), F.sum("uncompressed_len").cast("long").alias("inflated"))


def _bgzf_inflate_stats(s, d):
    """How many members inflate to how many bytes."""
    return _Files(s, d).read("bgzf").groupBy(F.col("uncompressed_len").cast("long").alias("inflated")).agg(F.count("*").alias("members"))


def _scan_coverage(s, d):
    """Per file: what was written, what a scan gives, and whether its spans are all that the anchors make."""
    files = _Files(s, d)
    covered = files.by_ref(cover.file_coverage(s, files.read(), files.paths)).drop("compressed_bytes")
    written = files.by_ref(files.manifest.select(F.col("path").alias("file_id"), F.col("records").alias("written")))
    return covered.join(written, "file_id")


def _region(s, d):
    """Records of one reference between two positions, of files that hold several references; the index chooses what is read."""
    rows = _Files(s, d, by_reference=False).read(columns=("ref_id", "pos", "flag", "mapq", "next_ref_id")).where(F.col("ref_id").isin(*REGION[0]) & F.col("pos").between(*REGION[1]))
    return rows


def _file_spans(s, d):
    """The totals of every span of every file."""
    files = _Files(s, d)
    return files.by_ref(batches.by_span(files.read()))


def _file_batches(s, d):
    """The totals of batches of consecutive spans of at most CAP bytes."""
    files = _Files(s, d)
    return files.by_ref(batches.by_batch(files.read(), CAP))


def _field_decode_from_bam(s, d):
    """Fields decoded by column expressions from the bytes of the records of files."""
    raw = F.col("record")
    return _Files(s, d).read(columns=["record"], record="true").select(codecs.le_int(raw, 4, 4).cast("int").alias("ref_id"), codecs.le_int(raw, 8, 4).cast("int").alias("pos"), codecs.le_uint(raw, 13, 1).cast("int").alias("mapq"), codecs.le_uint(raw, 18, 2).cast("int").alias("flag"), codecs.le_int(raw, 24, 4).cast("int").alias("next_ref_id"))


def _span_status_from_bam(s, d):
    """Files some of whose windows have records of false sizes: the first broken span of each, and the totals of its good ones."""
    rows = alignments(s, d).withColumn("block_size", F.expr(_FALSE_SIZE.replace("//", "div")).cast("int"))
    files = _Files(s, d, rows)
    read = files.read(mode="permissive")
    good = ops.counters(read.where("status = 0"), F.col("path").alias("file_id")).select("file_id", "n_reads_pass", "n_reads_fail", "n_dup_pass", "n_diffchr_pass")
    return files.by_ref(good.join(batches.first_broken(read), "file_id", "left"))


def damaged(spark: SparkSession, places: DataFrame) -> DataFrame:
    """Copies of files and their indexes with bytes inverted: (path, at) become (file_id, path) of the copies."""
    folder = new_path(spark, "damaged")

    def run(rows):
        made = []
        for batch in rows:
            for path, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copy = f"{folder}/{path.rsplit('/', 1)[1]}"
                for source, target, spots in ((path, copy, sorted(places)), (path + ".bai", copy + ".bai", [])):
                    with open_file(source) as old, create(target) as new:
                        at = 0
                        while part := bytearray(old.read(1 << 20)):
                            for spot in spots:
                                if at <= spot < at + len(part):
                                    part[spot - at] ^= 255
                            new.write(bytes(part))
                            at += len(part)
                made.append((path, copy))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*made, strict=True)], ["file_id", "path"])

    return materialize(places.groupBy("path").agg(F.collect_list("at").alias("places")).mapInArrow(run, "file_id string, path string"), "damaged")


def _integrity_scan(s, d):
    """One member of each file is damaged in its frame, its checksum or its stated size: which, how, and where the scan goes on."""
    files = _Files(s, d)
    members = files.by_ref(files.numbers.withColumn("ref", F.col("file_id")), "ref").where("member > 0 AND NOT is_eof")
    # the members of a file are few: their number decides which one it is
    chosen = members.join(members.groupBy("file_id").agg(F.count("*").alias("n")), "file_id").where("member = 1 + (ref * 7) % n")
    spot = F.expr("CASE ref % 3 WHEN 0 THEN compressed_offset WHEN 1 THEN compressed_offset + compressed_len - 8 ELSE compressed_offset + compressed_len - 1 END")
    copies = damaged(s, chosen.select(F.col("file_id").alias("path"), spot.alias("at")))
    found = s.read.format("bgzf").option("mode", "integrity").option("paths", json.dumps([r.path for r in copies.select("path").collect()])).load()
    own = found.join(copies, "path").select("file_id", "compressed_offset", "resumes", F.regexp_extract("reason", "no gzip member|incorrect data check|incorrect length check|more than 65536", 0).alias("reason"))
    places = files.numbers.select("file_id", "compressed_offset", "member")
    named = own.join(places, ["file_id", "compressed_offset"]).join(places.withColumnsRenamed({"compressed_offset": "resumes", "member": "resumes_at"}), ["file_id", "resumes"], "left")
    return files.by_ref(named.select("file_id", "member", "reason", "resumes_at"))


def _scan_metrics(s, d):
    """Per file: what the tasks of a scan say that they read."""
    files = _Files(s, d)
    folder = new_path(s, "metrics")
    files.read(metrics=folder).agg(F.count("*")).collect()
    covered = files.by_ref(cover.metrics_coverage(datasource.scan_metrics(s, folder)))
    return covered.select("file_id", "records", "spans", "anchors", "inflated_bytes", "complete")


def _file_stream(s, d):
    """The totals of a stream over a folder that grows between its runs."""
    datasource.register(s)
    folder, log, kept, state = (new_path(s, x) for x in ("growing", "growing-log", "growing-totals", "growing-state"))
    for part in ("ref_id < 12", "ref_id >= 12"):
        write_bam(alignments(s, d).where(part), folder, REFERENCES, MEMBER_BYTES)
        stream = s.readStream.format("bam").schema(datasource.schema_of(*ops.FIELDS)).options(streaming="files", fileLog=log, maxSplitsPerTrigger=20).load(folder)
        drain(stream, kept, state)
    return drained(s, kept)


def _flagstat_stream(s, d):
    return stream_totals(_Files(s, d).stream())


def _lineitem_stream(s, d):
    """The totals of a stream of files of the derived table."""
    # a pattern, as a stream takes a single file by pattern only
    rows = s.readStream.schema(_line(s, d).schema).parquet(f"{d}/lineitem.parque[t]")
    return stream_totals(rows.select(*[F.expr(v).alias(k) for k, v in _FIELDS.items()]))


QUERIES = {
    "flagstat_counters": lambda s, d: ops.flagstat(alignments(s, d)),
    "flagstat_report": lambda s, d: ops.report(ops.flagstat(alignments(s, d))),
    "flagstat_by_qc": lambda s, d: ops.by_qc(alignments(s, d)),
    "flagstat_by_span": lambda s, d: ops.counters(alignments(s, d), "span_id"),
    "flagstat_by_batch": lambda s, d: ops.counters(alignments(s, d), "batch_id"),
    "flagstat_merge": lambda s, d: ops.merge(ops.counters(alignments(s, d), "batch_id", "span_id")),
    "flagstat_preagg": lambda s, d: ops.flagstat(alignments(s, d), "preagg"),
    "flagstat_arrow": lambda s, d: ops.flagstat(alignments(s, d), "arrow"),
    "validate_counters": lambda s, d: ops.compare(alignments(s, d)),
    "flag_predicates": lambda s, d: ops.long_form(ops.flagstat(alignments(s, d))),
    "precedence": _precedence,
    "diff_chromosome": _diff_chromosome,
    "mapq_boundary": _mapq_boundary,
    "virtual_offset_codec": _virtual_offset_codec,
    "bai_coordinates": _bai_coordinates,
    "padded_sizes": _padded_sizes,
    "capacity_classes": _capacity_classes,
    "timestamp_delta": _timestamp_delta,
    "span_status": _span_status,
    "anchors": lambda s, d: _Files(s, d).anchors,
    "span_bounds": lambda s, d: plans.span_bounds(_Files(s, d).anchors),
    "span_checks": _span_checks,
    "span_windows": _span_windows,
    "anchor_member_join": _anchor_member_join,
    "batch_plan": lambda s, d: plans.batch_plan(_Files(s, d).placed, CAP),
    "block_map": lambda s, d: _Files(s, d).block_map,
    "translate_offsets": _translate,
    "bgzf_prefix": _prefix,
    "vector_add": _vector_add,
    "field_decode": _field_decode,
    "alignments_scan": _alignments_scan,
    "record_framing": _record_framing,
    "flagstat_from_bam": lambda s, d: ops.flagstat(_read(s, d)),
    "flagstat_report_from_bam": lambda s, d: ops.report(ops.flagstat(_read(s, d), "arrow")),
    "bam_header": _bam_header,
    "bai_linear_index": _bai_linear_index,
    "physical_endpoints": _physical_endpoints,
    "bgzf_members": _bgzf_members,
    "bgzf_inflate_stats": _bgzf_inflate_stats,
    "scan_coverage": _scan_coverage,
    "region_scan": _region,
    "flagstat_by_file_span": _file_spans,
    "flagstat_by_file_batch": _file_batches,
    "field_decode_from_bam": _field_decode_from_bam,
    "span_status_from_bam": _span_status_from_bam,
    "integrity_scan": _integrity_scan,
    "scan_metrics": _scan_metrics,
    "flagstat_file_stream": _file_stream,
    "flagstat_stream": _flagstat_stream,
    "flagstat_lineitem_stream": _lineitem_stream,
}

_SPANS = f"""sp AS (SELECT ref_id AS file_id, CAST(dense_rank() OVER (PARTITION BY ref_id ORDER BY pos // 16384) - 1 AS BIGINT) AS span_id, a.* EXCLUDE (span_id, batch_id) FROM a),
sz AS (SELECT file_id, span_id, CAST(count(*) * {RECORD} AS BIGINT) AS bytes FROM sp GROUP BY ALL)"""
_FILE_BATCHES = f"""cu AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY file_id ORDER BY span_id) AS BIGINT) AS z FROM sz),
nx AS (SELECT c.file_id, c.z - c.bytes AS z0, max(x.z) AS z1 FROM cu c JOIN cu x ON x.file_id = c.file_id AND x.z > c.z - c.bytes AND x.z <= c.z - c.bytes + {CAP} GROUP BY ALL),
ba AS (SELECT file_id, 0::BIGINT AS z0, 0::BIGINT AS batch_id FROM (SELECT DISTINCT file_id FROM cu) UNION ALL SELECT ba.file_id, nx.z1, batch_id + 1 FROM ba JOIN nx USING (file_id, z0) WHERE EXISTS (SELECT 1 FROM nx n2 WHERE n2.file_id = ba.file_id AND n2.z0 = nx.z1)),
bs AS (SELECT cu.file_id, span_id, bytes, max(batch_id) AS batch_id FROM cu JOIN ba ON ba.file_id = cu.file_id AND ba.z0 <= cu.z - cu.bytes GROUP BY ALL)"""
_PLACED = "q AS (SELECT DISTINCT n.file_id, p.position + (packed & 65535) AS position FROM n JOIN p ON n.file_id = p.file_id AND (packed >> 16) = p.compressed_offset AND (packed & 65535) <= p.uncompressed_len)"
_BATCHES = f"""ends AS (SELECT file_id, min(position) AS a, max(position) AS z FROM q GROUP BY file_id),
steps AS (SELECT file_id, position, max(position) OVER (PARTITION BY file_id ORDER BY position RANGE BETWEEN CURRENT ROW AND {CAP} FOLLOWING) AS next FROM q),
b AS (SELECT file_id, a AS batch_start FROM ends UNION ALL SELECT b.file_id, steps.next FROM b JOIN steps ON steps.file_id = b.file_id AND steps.position = b.batch_start JOIN ends ON ends.file_id = b.file_id WHERE steps.next < ends.z)"""
_MAP = """be AS (SELECT b.file_id, batch_start, coalesce(lead(batch_start) OVER (PARTITION BY b.file_id ORDER BY batch_start), z) AS batch_end FROM b JOIN ends USING (file_id)),
mp AS (SELECT p.file_id, batch_start, compressed_offset, CAST(greatest(0, batch_start - position) AS BIGINT) AS src_start, CAST(least(uncompressed_len, batch_end - position) AS BIGINT) AS src_end, CAST(greatest(position, batch_start) - batch_start AS BIGINT) AS batch_from, CAST(least(position + uncompressed_len, batch_end) - batch_start AS BIGINT) AS batch_to FROM p JOIN be ON p.file_id = be.file_id AND position < batch_end AND position + uncompressed_len > batch_start)"""
_CLASS = "CASE WHEN l_partkey - 5 <= 0 OR l_partkey - 5 > 1500 THEN NULL ELSE least(1500, CAST(pow(2, ceil(log2(l_partkey - 5))) AS BIGINT)) END"

SQL = {
    **{k: _TOTALS for k in ("flagstat_counters", "flagstat_merge", "flagstat_preagg", "flagstat_arrow", "flagstat_from_bam", "flagstat_stream", "flagstat_lineitem_stream", "flagstat_file_stream")},
    "flagstat_report": _report_sql(),
    "flagstat_report_from_bam": _report_sql(),
    "flagstat_by_qc": f"WITH {_A}, t AS ({_totals_sql()}) " + " UNION ALL ".join(f"SELECT '{q}' AS category, " + ", ".join(f"{n}_{q} AS {n}" for n in NAMES) + " FROM t" for q in ("pass", "fail")),
    "flagstat_by_span": f"WITH {_A} {_totals_sql(keys='span_id')}",
    "flagstat_by_batch": f"WITH {_A} {_totals_sql(keys='batch_id')}",
    "validate_counters": f"SELECT *, TRUE AS engines_agree FROM ({_LONG})",
    "flag_predicates": _LONG,
    "precedence": f"WITH {_A} SELECT CASE WHEN (flag & 256) <> 0 THEN 'secondary' WHEN (flag & 2048) <> 0 THEN 'supplementary' ELSE 'primary' END AS class, (flag & 512) <> 0 AS failed, count(*) AS n FROM a GROUP BY ALL",
    "diff_chromosome": f"WITH {_A} SELECT ref_id, next_ref_id, n_diffchr_pass, n_diffchr_fail, n_diffhigh_pass, n_diffhigh_fail FROM ({_totals_sql(keys='ref_id, next_ref_id')})",
    "mapq_boundary": f"WITH {_A} SELECT mapq, n_diffchr_pass, n_diffchr_fail, n_diffhigh_pass, n_diffhigh_fail FROM ({_totals_sql(keys='mapq')})",
    "virtual_offset_codec": "SELECT (l_orderkey * 4099) * 65536 + l_partkey % 65536 AS packed, l_orderkey * 4099 AS compressed, CAST(l_partkey % 65536 AS INT) AS within FROM lineitem",
    "bai_coordinates": f"WITH {_A} SELECT CAST(ref_id AS BIGINT) * 4294967296 + (pos // 16384) * 16384 AS coordinate, count(*) AS n FROM a GROUP BY ALL",
    "padded_sizes": "SELECT (l_partkey + 3) // 4 * 4 AS padded, count(*) AS n FROM lineitem GROUP BY ALL",
    "capacity_classes": f"SELECT {_CLASS} AS capacity, count(*) AS n FROM lineitem GROUP BY ALL",
    "timestamp_delta": "SELECT l_orderkey, l_partkey, d AS ticks, d * 0.5::DOUBLE AS ms FROM (SELECT l_orderkey, l_partkey, ((l_partkey * 7919) % 65536 - (l_orderkey * 1237) % 65536 + 65536) % 65536 AS d FROM lineitem)",
    "span_status": f"WITH {_A}, st AS (SELECT batch_id, span_id, max(CASE WHEN flag % 7 = 0 THEN flag % 4 ELSE 0 END) AS status FROM a GROUP BY ALL), f AS (SELECT batch_id, min(span_id) AS span_id FROM st WHERE status <> 0 GROUP BY batch_id) SELECT f.batch_id, f.span_id, CAST(status AS INT) AS status, CASE status "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codecs.STATUS.items())
    + " END AS description FROM f JOIN st USING (batch_id, span_id)",
    "anchors": f"WITH {_MEMBERS} SELECT * FROM n",
    "span_bounds": f"WITH {_MEMBERS} SELECT * FROM (SELECT file_id, anchor_id AS span_id, packed AS span_start, lead(packed) OVER (PARTITION BY file_id ORDER BY packed) AS span_end FROM n) WHERE span_end IS NOT NULL",
    "span_windows": f"WITH {_MEMBERS}, s AS (SELECT file_id, anchor_id AS span_id, packed AS span_start, lead(packed) OVER (PARTITION BY file_id ORDER BY packed) AS span_end FROM n) SELECT s.file_id, span_id, span_start, ref_id, window_start FROM s LEFT JOIN e ON s.file_id = e.file_id AND span_start = e.packed WHERE span_end IS NOT NULL",
    "anchor_member_join": f"WITH {_MEMBERS} SELECT n.file_id, packed, compressed_offset, packed & 65535 AS within, position + (packed & 65535) AS position FROM n JOIN p ON n.file_id = p.file_id AND (packed >> 16) = compressed_offset AND (packed & 65535) <= uncompressed_len",
    "batch_plan": f"WITH RECURSIVE {_MEMBERS}, {_PLACED}, {_BATCHES} SELECT file_id, batch_start FROM b",
    "block_map": f"WITH RECURSIVE {_MEMBERS}, {_PLACED}, {_BATCHES}, {_MAP} SELECT * FROM mp",
    "translate_offsets": f"WITH RECURSIVE {_MEMBERS}, {_PLACED}, {_BATCHES}, {_MAP}, f AS (SELECT n.file_id, n.packed, batch_start, batch_from + (packed & 65535) - src_start AS batch_offset, row_number() OVER (PARTITION BY n.file_id, n.packed ORDER BY batch_start, batch_from + (packed & 65535) - src_start) AS r FROM n LEFT JOIN mp ON n.file_id = mp.file_id AND (n.packed >> 16) = mp.compressed_offset AND (packed & 65535) BETWEEN src_start AND src_end) SELECT file_id, packed, batch_start, batch_offset FROM f WHERE r = 1",
    "bgzf_prefix": f"WITH {_MEMBERS} SELECT file_id, count(*) AS members, CAST(sum(uncompressed_len) AS BIGINT) AS uncompressed_bytes FROM p WHERE position + uncompressed_len <= {PREFIX} GROUP BY file_id",
    "span_checks": f"WITH {_MEMBERS} SELECT file_id, count(*) - 1 AS spans, 0::BIGINT AS bad FROM n GROUP BY file_id",
    "vector_add": "SELECT l_orderkey, l_partkey, CAST(l_orderkey % 1000 AS FLOAT) + CAST((l_partkey // 10) % 1000 AS FLOAT) AS total FROM lineitem",
    "field_decode": f"WITH {_A} SELECT ref_id, mapq, flag, next_ref_id FROM a",
    "alignments_scan": f"WITH {_A} SELECT flag, mapq, ref_id, next_ref_id FROM a",
    "region_scan": f"WITH {_A} SELECT ref_id, pos, flag, mapq, next_ref_id FROM a WHERE ref_id IN {REGION[0]} AND pos BETWEEN {REGION[1][0]} AND {REGION[1][1]}",
    "flagstat_by_file_span": f"WITH {_A}, {_SPANS}, t AS ({_totals_sql('sp', 'file_id, span_id')}) SELECT t.*, bytes FROM t JOIN sz USING (file_id, span_id)",
    "flagstat_by_file_batch": f"WITH RECURSIVE {_A}, {_SPANS}, {_FILE_BATCHES}, rb AS (SELECT sp.*, batch_id FROM sp JOIN bs USING (file_id, span_id)), t AS ({_totals_sql('rb', 'file_id, batch_id')}), n AS (SELECT file_id, batch_id, count(*) AS spans, CAST(sum(bytes) AS BIGINT) AS bytes FROM bs GROUP BY ALL) SELECT t.*, spans, bytes FROM t JOIN n USING (file_id, batch_id)",
    "field_decode_from_bam": f"WITH {_A} SELECT ref_id, pos, mapq, flag, next_ref_id FROM a",
    "span_status_from_bam": f"""WITH {_A}, {_SPANS}, st AS (SELECT file_id, span_id, CASE any_value(pos // 16384) % 97 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 11 THEN CASE WHEN count(*) = 1 THEN 1 ELSE 3 END ELSE 0 END AS status FROM sp GROUP BY ALL),
t AS ({_totals_sql('(SELECT sp.* FROM sp JOIN st USING (file_id, span_id) WHERE status = 0) AS g', 'file_id')}),
b AS (SELECT file_id, count(*) AS broken, min(span_id) AS span_id, CAST(min_by(status, span_id) AS INT) AS status FROM st WHERE status <> 0 GROUP BY file_id)
SELECT t.file_id, n_reads_pass, n_reads_fail, n_dup_pass, n_diffchr_pass, broken, span_id, status, CASE status """
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in codecs.STATUS.items())
    + " END AS description FROM t LEFT JOIN b USING (file_id)",
    "integrity_scan": f"""WITH {_MEMBERS}, m AS (SELECT file_id, 1 + (file_id * 7) % n AS member, n FROM c), x AS (SELECT DISTINCT file_id, packed >> 16 AS place FROM e)
SELECT m.file_id, CAST(member AS BIGINT) AS member, ['no gzip member', 'incorrect data check', 'more than 65536'][1 + m.file_id % 3] AS reason, CAST(CASE WHEN m.file_id % 3 = 0 THEN (SELECT min(place) FROM x WHERE x.file_id = m.file_id AND place > member) ELSE member + 1 END AS BIGINT) AS resumes_at FROM m""",
    "scan_metrics": f"WITH {_MEMBERS}, s AS (SELECT file_id, count(*) AS spans FROM e GROUP BY file_id) SELECT file_id, bytes // {RECORD} AS records, spans, spans + 1 AS anchors, bytes AS inflated_bytes, TRUE AS complete FROM c JOIN s USING (file_id)",
    "record_framing": f"WITH {_MEMBERS}, s AS (SELECT file_id, count(*) AS spans FROM e GROUP BY file_id) SELECT file_id, bytes // {RECORD} AS records, bytes, spans, 0::BIGINT AS gaps FROM c JOIN s USING (file_id)",
    "bam_header": f"WITH {_MEMBERS} SELECT file_id, {REFERENCES} AS reference_count, first_record, data_end FROM z",
    "bai_linear_index": f"WITH {_MEMBERS} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY window_start) - 1 AS ordinal, packed, ref_id, window_start FROM e",
    "physical_endpoints": f"WITH {_MEMBERS} SELECT file_id, data_end, count(*) AS entries, CAST(count(*) FILTER (packed < first_record OR packed >= data_end) AS BIGINT) AS outside FROM e JOIN z USING (file_id) GROUP BY file_id, data_end",
    "bgzf_members": f"WITH {_MEMBERS} SELECT file_id, count(*) + 1 AS members, 1::BIGINT AS end_markers, CAST(sum(uncompressed_len) AS BIGINT) AS inflated FROM p GROUP BY file_id",
    "bgzf_inflate_stats": f"WITH {_MEMBERS} SELECT uncompressed_len AS inflated, count(*) AS members FROM p GROUP BY ALL UNION ALL SELECT 0::BIGINT, count(*) FROM c",
    "scan_coverage": f"WITH {_MEMBERS}, s AS (SELECT file_id, count(*) AS spans FROM e GROUP BY file_id) SELECT file_id, bytes // {RECORD} AS records, bytes AS record_bytes, spans, spans + 1 AS anchors, n + 2 AS members, bytes + {HEAD} AS inflated_bytes, TRUE AS complete, bytes // {RECORD} AS written FROM c JOIN s USING (file_id)",
}
