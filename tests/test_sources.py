"""Member framing, headers, indexes, record walks and the data sources."""

import json
import struct

import numpy as np
import pytest

from strandtally.cli import main
from strandtally.files import open_file
from strandtally.operators.flagstat import flagstat
from strandtally.sources import datasource
from strandtally.sources.bam import read_header, read_index, record_offsets, write_bam
from strandtally.sources.bgzf import EOF_MARKER, FormatError, data_end, deflate, read_member
from strandtally.streaming.flagstat import stream_totals

RECORDS = [(0xD00, 60, 0, 0, 5), (0x043, 4, 0, 1, 20000), (0x081, 5, 0, 1, 40000), (0x604, 0, -1, -1, -1)]
SCHEMA = "flag int, mapq int, ref_id int, next_ref_id int, pos int"


def record(flag, mapq, ref, mate, pad=0):
    body = bytearray(32 + pad)
    struct.pack_into("<i", body, 0, ref)
    body[9] = mapq
    struct.pack_into("<H", body, 14, flag)
    struct.pack_into("<i", body, 20, mate)
    return struct.pack("<I", len(body)) + bytes(body)


def head(references=1):
    return b"BAM\1" + struct.pack("<ii", 0, references) + b"".join(struct.pack("<i", 5) + f"chr{i}\0".encode() + struct.pack("<i", 1000) for i in range(references))


def index(offsets, trailer=b"", references=1):
    out = b"BAI\1" + struct.pack("<i", references) + struct.pack("<iIi", 1, 4681, 1) + b"\0" * 16 + struct.pack("<i", len(offsets)) + np.array(offsets, "<u8").tobytes()
    return out + struct.pack("<ii", 0, 0) * (references - 1) + trailer


@pytest.fixture
def put(tmp_path):
    def write(data, name="x.bam"):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    return write


def members(path):
    out = []
    with open_file(path) as f:
        while (m := read_member(f, path)) is not None:
            out.append(m)
    return out


def test_members_in_order(put):
    path = put(deflate(b"BAM-prefix-") + deflate(b"then-more-data") + EOF_MARKER)
    found = members(path)
    assert b"".join(m.inflate(path) for m in found[:2]) == b"BAM-prefix-then-more-data"
    assert [m.is_eof for m in found] == [False, False, True]
    with open_file(path) as f:
        assert data_end(f) == found[2].offset


GOOD = deflate(b"some data")


@pytest.mark.parametrize(
    ("data", "says"),
    [
        (b"\x1f\x8c" + GOOD[2:], "no gzip member"),
        (GOOD[:2] + b"\x07" + GOOD[3:], "unknown compression"),
        (GOOD[:3] + b"\xe4" + GOOD[4:], "reserved flags"),
        (GOOD[:3] + b"\x00" + GOOD[4:], "no extra field"),
        (GOOD[:12] + b"XX" + GOOD[14:], "missing BGZF BC"),
        (GOOD[:14] + b"\x09\x00" + GOOD[16:], "overruns"),
        (GOOD[:16] + b"\x10\x00" + GOOD[18:], "less than its header"),
        (GOOD[:-1], "truncated"),
        (GOOD[:5], "truncated"),
        (GOOD[:3] + b"\x0c" + GOOD[4:18] + b"\x01" * (len(GOOD) - 26) + GOOD[-8:], "unterminated name"),
        (GOOD[:-4] + struct.pack("<I", 70000), "more than 65536"),
    ],
)
def test_bad_members(put, data, says):
    with pytest.raises(FormatError, match=says):
        members(put(data))


@pytest.mark.parametrize("at", [-8, -4])
def test_bad_checksum_or_length(put, at):
    data = bytearray(GOOD)
    data[at] ^= 1
    path = put(bytes(data))
    with pytest.raises(FormatError, match="cannot inflate"):
        members(path)[0].inflate(path)


def test_largest_member():
    assert len(deflate(b"\x5a" * 65280)) < 1000


def test_header(put):
    first, rest = deflate(head()[:10]), deflate(head()[10:] + record(0, 0, 0, 0))
    assert read_header(put(first + rest)).first_record == len(first) << 16 | len(head()) - 10
    assert read_header(put(deflate(head()) + GOOD)).first_record == len(deflate(head())) << 16


@pytest.mark.parametrize(
    ("data", "says"),
    [
        (deflate(b"BAM\2" + head()[4:]), "not a BAM file"),
        (deflate(head()[:10]), "ends before its header"),
        (deflate(head()[:10]) + EOF_MARKER, "end marker"),
        (deflate(b"BAM\1" + struct.pack("<i", -1)), "negative"),
        (deflate(head().replace(b"chr0\0", b"chr01")), "does not end in NUL"),
    ],
)
def test_bad_headers(put, data, says):
    with pytest.raises(FormatError, match=says):
        read_header(put(data))


def test_index_keeps_repeats(put):
    references, rows = read_index(put(index([0, 123 << 16, 123 << 16], struct.pack("<Q", 7)), "x.bai"))
    assert references == 1
    assert rows.tolist() == [[0, 0, 16384, 123 << 16], [1, 0, 32768, 123 << 16]]


@pytest.mark.parametrize(("data", "says"), [(b"BAX\1", "not a BAI"), (index([1])[:-3], "truncated"), (index([1], b"abc"), "bytes after"), (b"BAI\1" + struct.pack("<i", -2), "negative"), (b"BAI\1" + struct.pack("<iii", 1, 0, 1 << 20), "window start")])
def test_bad_indexes(put, data, says):
    with pytest.raises(FormatError, match=says):
        read_index(put(data, "x.bai"))


def test_record_walk():
    a, b = record(1, 0, 0, 0, pad=1), record(2, 0, 0, 0)
    data = np.frombuffer(a + b + b, np.uint8)
    offsets, spans, status = record_offsets(data, np.array([0, len(a)]), np.array([len(a), len(data)]))
    assert offsets.tolist() == [0, len(a), len(a) + len(b)]
    assert spans.tolist() == [0, 1, 1]
    assert not status.any()
    short = np.frombuffer(b + b"\1\0\0", np.uint8)
    assert record_offsets(short, np.array([0]), np.array([len(short)]))[2].tolist() == [1]
    small = np.frombuffer(b + struct.pack("<I", 31) + bytes(31), np.uint8)
    assert record_offsets(small, np.array([0]), np.array([len(small)]))[2].tolist() == [2]
    over = np.frombuffer(b[:-1], np.uint8)
    assert record_offsets(over, np.array([0]), np.array([len(over)]))[2].tolist() == [3]


@pytest.mark.parametrize("few", [0, 40])
def test_long_spans_are_walked_alike(monkeypatch, few):
    """Spans of very different lengths, whole and broken, give the same offsets and states by either walk."""
    from strandtally.sources import bam

    monkeypatch.setattr(bam, "FEW_SPANS", few)
    r = np.random.default_rng(3)
    parts = [b"".join(record(1, 0, 0, 0, pad=int(p)) for p in r.integers(0, 9, n)) + tail for n, tail in ((300, b""), (2, b"\1"), (50, b""), (1, b"\5\0\0\0"), (3, b"\x64\0\0\0" + bytes(50)), (0, b"\0"))]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    offsets, spans, status = record_offsets(data, ends - [len(p) for p in parts], ends)
    assert status.tolist() == [0, 1, 0, 2, 3, 1]
    assert np.bincount(spans, minlength=6).tolist() == [300, 2, 50, 1, 3, 0]
    assert (np.diff(offsets) > 0).all()


def test_prefix(spark, put):
    datasource.register(spark)
    load = lambda path, **o: spark.read.format("bgzf").options(mode="prefix", **o).load(path)
    path = put(deflate(b"abcd") + deflate(b"efgh") + deflate(b"ijkl") + EOF_MARKER + b"no member at all")
    assert [r.uncompressed_len for r in load(path).orderBy("compressed_offset").collect()] == [4, 4, 4]
    assert load(path, maxUncompressedBytes=11).count() == 2
    assert load(path, maxUncompressedBytes=4).count() == 1
    for cap, says in ((3, "more than the 3 asked for"), (0, "must be between")):
        with pytest.raises(Exception, match=says):
            load(path, maxUncompressedBytes=cap).count()
    for data in (b"", EOF_MARKER):
        with pytest.raises(Exception, match="no members with data"):
            load(put(data)).count()
    with pytest.raises(Exception, match="truncated"):
        load(put(deflate(b"abcd") + GOOD[:-3])).count()
    with pytest.raises(Exception, match="unknown mode"):
        spark.read.format("bgzf").option("mode", "suffix").load(path).count()


def test_members_in_splits(spark, put):
    datasource.register(spark)
    path = file_with(put, [record(*r[:4]) for r in RECORDS] * 5, 40, list(range(1, 20)))
    whole = sorted(map(tuple, spark.read.format("bgzf").load(path).collect()))
    assert [r[1] for r in whole] == [m.offset for m in members(path)]
    for step in (30, 100, 333):
        assert sorted(map(tuple, spark.read.format("bgzf").option("maxCompressedBytes", step).load(path).collect())) == whole


def test_writer_streams_members(spark, tmp_path):
    """Records that span members, in small members and large, by reference and by range."""
    datasource.register(spark)
    rows = [(i % 4096, i % 60, i % 3, (i + 1) % 3, (i * 7919) % 10**6) for i in range(3000)] + [(4, 0, -1, -1, -1)] * 5
    records = spark.createDataFrame(rows, SCHEMA)
    for size, by in ((37, False), (100, True), (65280, True)):
        manifest = write_bam(records, f"{tmp_path}/{size}{by}", 3, size, by).collect()
        assert sum(r.records for r in manifest) == len(rows)
        read = spark.read.format("bam").option("paths", json.dumps([r.path for r in manifest])).load()
        assert flagstat(read).first() == flagstat(records).first()
        if by:
            assert len(manifest) == 4
        path = next(r.path for r in manifest if r.records > 5)
        assert len(datasource.anchors(path)) > 10


def file_with(put, records, member_bytes, anchors):
    """A file whose index names the records of these numbers."""
    body = b"".join(records)
    parts = [deflate(head()), *(deflate(body[i : i + member_bytes]) for i in range(0, len(body), member_bytes))]
    begins = np.cumsum([0, *map(len, parts)])
    at = np.cumsum([0, *map(len, records)])
    offsets = [int(begins[1 + at[i] // member_bytes]) << 16 | int(at[i] % member_bytes) for i in anchors]
    put(index(offsets), "x.bam.bai")
    return put(b"".join(parts) + EOF_MARKER)


@pytest.mark.parametrize(("member_bytes", "anchors", "compressed"), [(40, [1, 2], 60), (72, [2], 60), (1000, [1, 3], 1 << 20), (36, [1, 2, 3], 1 << 20), (50, [], 60), (40, [1, 2, 3], 45)])
def test_source_covers_each_record_once(spark, put, member_bytes, anchors, compressed):
    datasource.register(spark)
    raw = [record(*r[:4]) for r in RECORDS]
    path = file_with(put, raw, member_bytes, anchors)
    rows = spark.read.format("bam").option("maxCompressedBytes", compressed).load(path)
    got = sorted((r.flag, r.mapq, r.ref_id, r.next_ref_id) for r in rows.collect())
    assert got == sorted(r[:4] for r in RECORDS)
    assert rows.select("span_id").distinct().count() == len(anchors) + 1
    stream = spark.readStream.format("bam").option("maxCompressedBytes", compressed).load(path)
    assert stream_totals(stream).first() == flagstat(rows).first()


def test_source_errors(spark, put):
    datasource.register(spark)
    raw = [record(*r[:4]) for r in RECORDS]
    load = lambda path, **o: spark.read.format("bam").options(**o).load(path).count()
    path = file_with(put, raw, 40, [2])
    assert load(path) == 4
    with pytest.raises(Exception, match="exceeds the configured"):
        load(path, maxUncompressedBytes=40)
    with pytest.raises(Exception, match="must be between"):
        load(path, maxUncompressedBytes=0)
    put(index([1], references=2), "x.bam.bai")
    with pytest.raises(Exception, match="2 references"):
        load(path)
    path = file_with(put, [*raw, raw[0][:-1]], 1000, [])
    with pytest.raises(Exception, match="extends past it"):
        load(path)
    path = file_with(put, [], 1000, [])
    with pytest.raises(Exception, match="there are no records"):
        load(path)
    with pytest.raises(Exception, match="nothing.bam"):
        load(path.replace("x.bam", "nothing.bam"))


def test_round_trip_and_command_line(spark, tmp_path, capsys):
    records = spark.createDataFrame(RECORDS * 500, SCHEMA)
    datasource.register(spark)
    manifest = write_bam(records.coalesce(1), f"{tmp_path}/out", 2, member_bytes=1000).collect()
    assert sum(r.records for r in manifest) == 2000
    paths = json.dumps([r.path for r in manifest])
    assert flagstat(spark.read.format("bam").option("paths", paths).load()).first() == flagstat(records).first()
    assert main(["flagstat", manifest[0].path, "--validate", "--benchmark"], spark) == 0
    said = capsys.readouterr()
    assert len(said.out.splitlines()) == 16
    assert "all engines agree" in said.err
    assert "master local" in said.err and "GB/s" in said.err
    cover = dict(x.rsplit(" ", 1) for line in said.err.splitlines() if line.startswith(("files", "records")) for x in line.split(", "))
    assert int(cover["spans"]) + 1 == int(cover["anchors"]) and int(cover["records"]) == manifest[0].records
    assert main(["flagstat", "missing.bam"], spark) == 1
    assert capsys.readouterr().err.startswith("strandtally: ")


@pytest.mark.parametrize("argv", [[], ["view"], ["flagstat"], ["flagstat", "a", "b"], ["flagstat", "a", "--engine", "cuda"], ["flagstat", "a", "--threads", "0"], ["flagstat", "a", "--max-uncompressed-bytes", "4294967296"], ["flagstat", "a", "--bai", "x", "--bai", "y"], ["flagstat", "a", "--x"]])
def test_bad_command_lines(argv, capsys):
    with pytest.raises(SystemExit):
        main(argv)


def test_bounded_stream_reaches_the_end(spark, put, tmp_path):
    """One range a micro-batch, with the default trigger."""
    from strandtally.operators.flagstat import counters

    datasource.register(spark)
    path = file_with(put, [record(*r[:4]) for r in RECORDS], 40, [1, 2, 3])
    stream = spark.readStream.format("bam").option("streaming", "bounded").option("maxCompressedBytes", 60).load(path)
    query = counters(stream).writeStream.outputMode("complete").format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        batches = [p for p in query.recentProgress if p.numInputRows]
    finally:
        query.stop()
    assert spark.table("bounded").first() == flagstat(spark.read.format("bam").load(path)).first()
    assert len(batches) == sum(bool(datasource.spans_of(s)) for s in datasource.splits(path, 60)) > 1


def test_relations_of_real_files(spark, put):
    """Anchors, spans and coverage from the sources are those of the reader; a scan that lacks a span is found out."""
    from strandtally.operators import coverage
    from strandtally.plans import spans

    datasource.register(spark)
    path = file_with(put, [record(*r[:4]) for r in RECORDS], 40, [1, 2, 2])
    anchored = spans.anchors(coverage.ends(spark, [path]), coverage.entries(spark, [path]))
    assert [r.packed for r in anchored.orderBy("packed").collect()] == datasource.anchors(path).tolist()
    rows = spark.read.format("bam").load(path)
    covered = coverage.file_coverage(spark, rows, [path])
    r = covered.first()
    assert (r.records, r.record_bytes, r.spans, r.anchors, r.members, r.complete) == (4, 144, 3, 4, 6, True)
    assert r.inflated_bytes == len(head()) + 144
    coverage.check_coverage(covered)
    with pytest.raises(ValueError, match="do not cover"):
        coverage.check_coverage(coverage.file_coverage(spark, rows.where("span_id <> 1"), [path]))


def test_campaign(spark):
    from strandtally.operators.coverage import campaign

    runs = spark.createDataFrame([("a", 1.0, 10**9), ("a", 3.0, 10**9), ("a", 2.0, 10**9), ("b", 4.0, 10**9), ("c", 0.0, 1)], "name string, seconds double, logical_bytes long")
    got = {r.name: tuple(r)[1:] for r in campaign(runs.where("name <> 'c'")).collect()}
    assert got == {"a": (3, 2.0, 1.0, 3.0, 0.5, 1.0), "b": (1, 4.0, 4.0, 4.0, 0.25, 2.0)}
    assert campaign(runs.where("name = 'c'")).first().gb_per_s is None
