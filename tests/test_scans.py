"""Pruned scans, cached indexes, permissive mode, integrity scans, growing streams, batches and metrics."""

import gc
import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import strandtally.files as store_files
from strandtally.cli import main
from strandtally.functions import codecs
from strandtally.operators import batches, coverage
from strandtally.operators.flagstat import counters, flagstat
from strandtally.queries import damaged
from strandtally.sources import bam, datasource
from strandtally.sources.bam import decode, write_bam
from strandtally.sources.bgzf import EOF_MARKER, deflate
from strandtally.streaming.flagstat import drain, drained

SCHEMA = "flag int, mapq int, ref_id int, next_ref_id int, pos int"


@pytest.fixture
def files(spark, tmp_path):
    """Records of several references in a few files, unplaced ones among them."""
    datasource.register(spark)
    rows = [(i % 4096, i % 60, i % 5, (i + 1) % 5, (i * 7919) % 10**6) for i in range(6000)] + [(4, 0, -1, -1, -1)] * 50
    records = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    paths = [r.path for r in write_bam(records, f"{tmp_path}/bam", 5, 1000).collect()]
    return rows, paths


def read(spark, paths, source="bam", **options):
    return spark.read.format(source).option("paths", json.dumps(paths)).options(**({"maxCompressedBytes": 2000} | options)).load()


def key(rows):
    return sorted(map(tuple, rows))


@pytest.mark.parametrize(
    ("where", "test"),
    [
        ("ref_id = 2", lambda r: r[2] == 2),
        ("ref_id = 2 and pos >= 300000 and pos < 400000", lambda r: r[2] == 2 and 300000 <= r[4] < 400000),
        ("ref_id in (1, 4) and pos > 900000", lambda r: r[2] in (1, 4) and r[4] > 900000),
        ("ref_id > 2", lambda r: r[2] > 2),
        ("ref_id <= 1", lambda r: r[2] <= 1),
        ("ref_id = -1", lambda r: r[2] == -1),
        ("ref_id < 0 or ref_id = 3", lambda r: r[2] in (-1, 3)),
        ("ref_id = 9", lambda r: False),
        ("ref_id in (0, 9) and mapq >= 30 and flag = 8", lambda r: r[2] == 0 and r[1] >= 30 and r[0] == 8),
        ("pos = 7919 and (flag & 1) = 1", lambda r: r[4] == 7919 and r[0] & 1),
        ("ref_id = 3 and pos > 2000000", lambda r: False),
        ("next_ref_id <> ref_id and mapq = 5", lambda r: r[3] != r[2] and r[1] == 5),
        ("ref_id = 1 and ref_id = 2", lambda r: False),
    ],
)
def test_predicates_choose_records(spark, files, where, test):
    rows, paths = files
    got = read(spark, paths).where(where).select("flag", "mapq", "ref_id", "next_ref_id", "pos").collect()
    assert key(got) == key(r for r in rows if test(r))


def test_pruned_bytes(spark, files, tmp_path):
    """One reference, or a part of it, inflates what holds it and little more; other splits nothing."""
    _, paths = files
    took = {}
    for name, where in (("all", "true"), ("one", "ref_id = 2"), ("part", "ref_id = 2 and pos between 300000 and 310000"), ("none", "ref_id = 9")):
        folder = f"{tmp_path}/{name}"
        read(spark, paths, metrics=folder).where(where).agg(F.count("*")).collect()
        took[name] = datasource.scan_metrics(spark, folder).collect()
    size = {k: sum(r.inflated_bytes for r in v) for k, v in took.items()}
    assert len(took["all"]) == len(took["none"]) > 20
    assert size["none"] < 0.1 * size["all"]  # an unknown reference may follow the last entry
    assert size["one"] < 0.35 * size["all"]
    assert size["part"] < 0.3 * size["one"]
    assert sum(r.inflated_bytes == 0 for r in took["one"]) > 10
    assert size["all"] >= 6050 * 37


def test_predicates_that_stay_with_spark(spark, files):
    """What the source cannot decide is in the plan's filter; what it can is not."""
    _, paths = files
    plan = lambda where: read(spark, paths).where(where)._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " in plan("(flag & 4) = 4 and ref_id = 2")
    assert ") Filter " in plan("path like '%x%'")
    assert ") Filter " not in plan("ref_id = 2 and pos >= 5")


def test_ranges_of_offsets():
    """By hand: entries of references 0, 1, 3; spans at 10, 20, ... 70, end 80."""
    rows = np.array([[0, 0, 0, 10], [1, 0, 16384, 20], [2, 1, 32768, 40], [3, 3, 0, 60]])
    index = datasource.Index(np.array([10, 20, 30, 40, 50, 60, 70, 80]), rows)

    def ranges(*tests):
        p = datasource.Predicates()
        p.tests = list(tests)
        return p.offsets(index)

    assert ranges() is None
    assert ranges(("pos", "ge", 5)) is None
    assert ranges(("ref_id", "eq", 0)) == [(0, 40)]
    assert ranges(("ref_id", "eq", 0), ("pos", "ge", 20000)) == [(20, 40)]
    assert ranges(("ref_id", "eq", 0), ("pos", "ge", 40000)) == []
    assert ranges(("ref_id", "eq", 1)) == [(20, 60)]
    assert ranges(("ref_id", "in", [1, 3])) == [(20, 60), (40, 80)]
    assert ranges(("ref_id", "gt", 1)) == [(40, 80)]
    assert ranges(("ref_id", "lt", 1)) == [(0, 40), (60, 80)]
    assert ranges(("ref_id", "eq", -1)) == [(60, 80)]
    assert ranges(("ref_id", "in", [])) == []


def test_index_is_read_once(spark, files, tmp_path, monkeypatch):
    """A thousand splits of a file, and its index is read once; and by a scan, once a worker at most."""
    _, paths = files
    calls = []
    monkeypatch.setattr(datasource, "read_index", lambda p: calls.append(p) or bam.read_index(p))
    datasource._kept.clear()
    size = datasource.size_of(paths[0])
    many = datasource.splits(paths[0], max(1, size // 1000))
    assert len(many) >= 1000
    assert sum(len(r.anchors) - 1 for s in many for r in datasource.spans_of(s)) == len(datasource.anchors(paths[0])) - 1
    assert calls == [paths[0] + ".bai"]
    folder = f"{tmp_path}/metrics"
    read(spark, paths[:1], metrics=folder, maxCompressedBytes=max(1, size // 200)).agg(F.count("*")).collect()
    found = datasource.scan_metrics(spark, folder)
    assert found.count() >= 200
    assert found.agg(F.sum("index_reads")).first()[0] <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("compressed", [2000, 1 << 30])
def test_members_that_splits_share_count_once(spark, files, tmp_path, compressed):
    """However a file is cut, its metrics add up to what its members hold."""
    _, paths = files
    held = {r.file_id: r for r in coverage.members(spark, paths).where("compressed_offset > 0 and not is_eof").groupBy("file_id").agg(F.count("*").alias("n"), F.sum("compressed_len").alias("c"), F.sum("uncompressed_len").alias("u")).collect()}
    read(spark, paths, metrics=f"{tmp_path}/metrics", maxCompressedBytes=compressed).agg(F.count("*")).collect()
    found = datasource.scan_metrics(spark, f"{tmp_path}/metrics")
    covered = coverage.metrics_coverage(found).collect()
    assert sorted((r.file_id, r.members, r.compressed_bytes, r.inflated_bytes) for r in covered) == sorted((k, r.n, r.c, r.u) for k, r in held.items())
    assert all(r.complete and r.spans + 1 == r.anchors for r in covered)
    # splits still tell what each of them took
    assert compressed == 1 << 30 or found.agg(F.sum("inflated_bytes")).first()[0] > sum(r.u for r in held.values())


def test_metrics_of_shared_members_by_hand(spark):
    """Two splits share the member at 90, which one of them reads for two runs; a split without spans has no edges."""
    edge = lambda offset: {"offset": offset, "compressed_bytes": 10, "inflated_bytes": 100}
    one = datasource.Metrics("f", 0, anchors=4, spans=1)
    two = datasource.Metrics("f", 50, anchors=4, spans=2)
    for at in (0, 30, 60, 90):
        one.inflated(at, 10, 100, 0)
    two.inflated(90, 10, 100, 0)
    two.inflated(90, 10, 100, 1)
    two.inflated(120, 10, 100, 1)
    assert (one.edges, two.edges) == ([edge(0), edge(90)], [edge(90), edge(90), edge(120)])
    rows = [json.dumps(vars(m)) for m in (one, two, datasource.Metrics("f", 200, anchors=4))]
    metrics = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", datasource.METRICS).alias("m")).select("m.*")
    r = coverage.metrics_coverage(metrics).first()
    assert (r.splits, r.members, r.compressed_bytes, r.inflated_bytes, r.complete) == (3, 5, 50, 500, True)


def test_kept_indexes_are_bounded(files, spark, monkeypatch):
    _, paths = files
    datasource._kept.clear()
    monkeypatch.setattr(datasource, "INDEX_BYTES", 1)
    for p in paths * 2:
        assert datasource.index_of(p)[1] or len(paths) == 1
    assert len(datasource._kept) == 1


def broken(put_path, kinds):
    """A file with a span for each kind: 0 good, 1 trailing bytes, 2 short record, 3 long record; two good records before each fault."""
    def record(size=32):
        return struct.pack("<IiiBBHHHiiii", size, 0, 5, 1, 9, 0, 0, 2, 0, 0, 0, 0)

    spans = [record() * 2 + {0: b"", 1: b"\1\2\3", 2: record(31), 3: record(33)}[k] for k in kinds]
    head = b"BAM\1" + struct.pack("<iii", 0, 1, 5) + b"chr0\0" + struct.pack("<i", 1000)
    parts = [deflate(head), *map(deflate, spans)]
    begins = np.cumsum([0, *map(len, parts)])
    put_path.write_bytes(b"".join(parts) + EOF_MARKER)
    offsets = np.array([b << 16 for b in begins[1:-1].tolist()], "<u8")
    (put_path.parent / (put_path.name + ".bai")).write_bytes(b"BAI\1" + struct.pack("<iii", 1, 0, len(offsets)) + offsets.tobytes())
    return str(put_path)


def test_broken_spans_are_rows(spark, tmp_path):
    datasource.register(spark)
    path = broken(tmp_path / "b.bam", [0, 3, 0, 1, 2, 0])
    rows = spark.read.format("bam").option("mode", "permissive").load(path)
    assert rows.where("status = 0").count() == 6
    assert flagstat(rows.where("status = 0")).first().n_reads_pass == 6
    found = {r.span_id: (r.status, r.description) for r in batches.broken_spans(rows).collect()}
    assert found == {i: (k, codecs.STATUS[k]) for i, k in ((1, 3), (3, 1), (4, 2))}
    first = batches.first_broken(rows).first()
    assert (first.broken, first.span_id, first.status) == (3, 1, 3)
    with pytest.raises(Exception, match="span 1 has a record that extends past it"):
        spark.read.format("bam").load(path).count()
    with pytest.raises(Exception, match="unknown mode"):
        spark.read.format("bam").option("mode", "lenient").load(path).count()
    both = spark.read.format("bam").options(mode="permissive", record="true").load(path)
    assert both.where("record is null").count() == 3
    good = broken(tmp_path / "g.bam", [0, 0])
    assert batches.first_broken(spark.read.format("bam").option("mode", "permissive").load(good)).count() == 0


def test_record_bytes(spark, files):
    """Column expressions on the bytes give what the reader gives."""
    _, paths = files
    raw = F.col("record")
    rows = read(spark, paths, record="true")
    wrong = rows.where(
        (codecs.le_uint(raw, 0, 4) != F.col("block_size")) | (codecs.le_int(raw, 4, 4) != F.col("ref_id")) | (codecs.le_int(raw, 8, 4) != F.col("pos")) | (codecs.le_uint(raw, 13, 1) != F.col("mapq"))
        | (codecs.le_uint(raw, 18, 2) != F.col("flag")) | (codecs.le_int(raw, 24, 4) != F.col("next_ref_id")) | (F.length(raw) != F.col("block_size") + 4)
    )
    assert rows.count() == 6050
    assert wrong.count() == 0


def test_record_bytes_by_hand():
    """Records side by side, with gaps, at the ends, alone, and none."""
    data = np.arange(100, dtype=np.uint8)
    for cuts in ([(0, 40), (40, 100)], [(0, 36), (40, 76), (76, 99)], [(5, 100)], [(99, 100)], []):
        begins, ends = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
        got = datasource.record_bytes(data, begins, ends)
        got.validate(full=True)
        assert got.to_pylist() == [bytes(range(a, b)) for a, b in cuts]
        # as after other slices of a larger buffer
        assert datasource.record_bytes(data[10:][:80], begins[:0], ends[:0]).to_pylist() == []


def test_record_bytes_are_let_go(files):
    """A worker that reads many splits holds none of their records: they left 220 bytes each, here 27 MB."""
    _, paths = files

    def scan(times: int) -> int:
        n = 0
        for _ in range(times):
            for path in paths:
                metrics = datasource.Metrics(path, 0)
                for part in datasource.spans_of(datasource.Split(path, 0, 1 << 40)):
                    n += sum(b.num_rows for b in datasource.read_range(part, 1 << 20, datasource.Predicates(), metrics, ["record"]))
        return n

    def held() -> int:
        gc.collect()
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    scan(5)
    before = held()
    assert scan(20) == 20 * 6050
    assert held() - before < 12_000_000


def test_damage_is_found_where_it_is(spark, files):
    """Three members of one file: a checksum, a frame, and a stated size; all others are sound."""
    _, paths = files
    found = [r for r in coverage.members(spark, paths[:1]).orderBy("compressed_offset").collect() if not r.is_eof]
    a, b, c = found[3], found[10], found[20]
    spots = [(paths[0], a.compressed_offset + a.compressed_len - 8), (paths[0], b.compressed_offset), (paths[0], c.compressed_offset + c.compressed_len - 1)]
    copy = damaged(spark, spark.createDataFrame(spots, "path string, at long")).first().path
    named = sorted({int(x) >> 16 for x in bam.read_index(copy + ".bai")[1][:, 3]})
    onward = lambda at: next((n for n in named if n > at), None)
    for step in (500, 1 << 20):
        rows = spark.read.format("bgzf").options(mode="integrity", maxCompressedBytes=step).load(copy).orderBy("compressed_offset").collect()
        assert [r.compressed_offset for r in rows] == [a.compressed_offset, b.compressed_offset, c.compressed_offset]
        assert rows[0].resumes == found[4].compressed_offset
        assert rows[1].resumes == onward(b.compressed_offset)
        assert rows[2].resumes == found[21].compressed_offset
        for r, says in zip(rows, ("incorrect data check", "no gzip member", "more than 65536"), strict=True):
            assert says in r.reason
    assert spark.read.format("bgzf").option("mode", "integrity").option("paths", json.dumps(paths)).load().count() == 0


def test_integrity_without_index(spark, tmp_path):
    datasource.register(spark)
    good, path = deflate(b"some data"), tmp_path / "x.bam"
    path.write_bytes(good + good[:-8] + b"\0" * 8 + good + b"rubbish" + good)
    rows = spark.read.format("bgzf").options(mode="integrity", maxCompressedBytes=20).load(str(path)).orderBy("compressed_offset").collect()
    assert [(r.compressed_offset, r.resumes) for r in rows] == [(len(good), 2 * len(good)), (3 * len(good), None)]


@pytest.mark.parametrize("cap", [100, 250, 10**6])
def test_batches_are_greedy(spark, files, cap):
    _, paths = files
    rows = read(spark, paths)
    spans = {}
    for r in batches.by_span(rows).collect():
        spans.setdefault(r.file_id, []).append((r.span_id, r.bytes, r.n_reads_pass + r.n_reads_fail))
    if max(b for own in spans.values() for _, b, _ in own) > cap:
        with pytest.raises(Exception, match="exceeds the configured"):
            batches.by_batch(rows, cap).collect()
        return
    want = {}
    for file, own in spans.items():
        batch, held = 0, 0
        for _, size, n in sorted(own):
            if held and held + size > cap:
                batch, held = batch + 1, 0
            held += size
            old = want.get((file, batch), (0, 0, 0))
            want[file, batch] = (old[0] + 1, old[1] + size, old[2] + n)
    got = {(r.file_id, r.batch_id): (r.spans, r.bytes, r.n_reads_pass + r.n_reads_fail) for r in batches.by_batch(rows, cap).collect()}
    assert got == want


def test_growing_folder(spark, tmp_path):
    """Files that come between runs are read once, by so many splits a batch; a new query on the checkpoint repeats none."""
    datasource.register(spark)
    folder, log, kept, state = (f"{tmp_path}/{n}" for n in ("bam", "log", "kept", "state"))

    def put(lo, hi):
        rows = spark.createDataFrame([(i % 4096, i % 60, i % 3, 0, (i * 7919) % 10**6) for i in range(lo, hi)], SCHEMA)
        return len(write_bam(rows.coalesce(1), folder, 3, 500).collect())

    def stream(most=3):
        return spark.readStream.format("bam").options(streaming="files", fileLog=log, maxSplitsPerTrigger=most, maxCompressedBytes=4000).load(folder)

    total = lambda: (lambda r: r.n_reads_pass + r.n_reads_fail)(drained(spark, kept).first())
    put(0, 3000)
    n = drain(stream(), kept, state)
    assert n >= 3
    assert total() == 3000
    assert drain(stream(), kept, state) == 0
    put(3000, 3500)
    (tmp_path / "bam" / "unfinished.bam").write_bytes(b"no index yet")
    assert drain(stream(1), kept, state) >= 1
    assert total() == 3500
    assert flagstat(spark.read.format("bam").option("paths", json.dumps([p for p in datasource.list_files(folder, ".bam") if "unfinished" not in p])).load()).first() == drained(spark, kept).first()
    with pytest.raises(Exception, match="needs the option fileLog"):
        counters(spark.readStream.format("bam").option("streaming", "files").load(folder)).writeStream.outputMode("complete").format("memory").queryName("bad").start().processAllAvailable()


def test_benchmark_reads_once(spark, files, capsys, monkeypatch):
    """Stage times and coverage come from the scan itself."""
    _, paths = files
    assert main(["flagstat", paths[0], "--benchmark"], spark) == 0
    said = capsys.readouterr().err
    for stage in datasource.STAGES:
        assert f"stage {stage}: " in said
    assert "index reads 1" in said


def test_payload(spark, tmp_path):
    """Records with symbols after their fields, as long as those of real files."""
    datasource.register(spark)
    rows = spark.createDataFrame([(i % 4096, i % 60, i % 3, 0, i) for i in range(1000)], SCHEMA)
    manifest = write_bam(rows.coalesce(1), f"{tmp_path}/p", 3, payload=463).collect()
    assert sum(r.bytes for r in manifest) == 500 * 1000
    scan = spark.read.format("bam").option("paths", json.dumps([r.path for r in manifest])).load()
    assert flagstat(scan).first() == flagstat(rows).first()
    assert scan.agg(F.min("block_size"), F.max("block_size")).first()[:] == (496, 496)


def test_columns_of_a_schema(spark, files, tmp_path):
    """A scan with a schema gives its columns alone, decodes no other fields, and takes predicates on them."""
    rows, paths = files
    scan = lambda *names, **more: spark.read.schema(datasource.schema_of(*names)).format("bam").option("paths", json.dumps(paths)).options(**more).load()
    assert key(scan("next_ref_id", "flag").collect()) == key((r[3], r[0]) for r in rows)
    assert key(scan("pos", "ref_id").where("ref_id = 2 and pos < 5000").collect()) == key((r[4], r[2]) for r in rows if r[2] == 2 and r[4] < 5000)
    assert scan("mapq").where("mapq = 7").count() == sum(r[1] == 7 for r in rows)
    assert scan("mapq").count() == len(rows)
    whole = read(spark, paths, record="true")
    assert key(scan("record", record="true").collect()) == key(whole.select("record").collect())
    assert key(scan("span_id", "record_offset", "path").collect()) == key(whole.select("span_id", "record_offset", "path").collect())
    # the rest of each record's bytes is not looked at
    data, offsets = np.zeros(100, np.uint8), np.array([0, 40])
    assert list(decode(data, offsets, ["flag"])) == ["flag"]


@pytest.mark.parametrize(
    ("schema", "options", "says"),
    [
        ("flag int, name string", {}, "no column name"),
        ("flag long", {}, "has the type int"),
        ("record binary", {}, "no column record"),
        ("flag int", {"mode": "permissive"}, "needs the column status"),
    ],
)
def test_bad_schemas(spark, files, schema, options, says):
    with pytest.raises(Exception, match=says):
        spark.read.schema(schema).format("bam").option("paths", json.dumps(files[1])).options(**options).load().collect()


def test_broken_spans_with_a_schema(spark, tmp_path):
    datasource.register(spark)
    records = spark.createDataFrame([(4, 9, 0, 0, i * 20000, 7 if i == 3 else 33) for i in range(8)], SCHEMA + ", block_size int").coalesce(1)
    paths = [r.path for r in write_bam(records, f"{tmp_path}/bam", 1, 1000).collect()]
    rows = spark.read.schema(datasource.schema_of("span_id", "flag", "status")).format("bam").options(mode="permissive", paths=json.dumps(paths)).load()
    assert [r.span_id for r in rows.where("status <> 0 and flag is null").collect()] == [3]
    assert rows.where("status = 0 and flag = 4").count() == 7


def test_store_is_asked_for_large_parts(files, monkeypatch):
    """A scan reads members in order; the store sees a read for each part of a file, not four for each member."""
    asked = []

    class Counted(io.RawIOBase):
        def __init__(self, inner):
            self.inner = inner

        readable = seekable = lambda self: True

        def seek(self, *at):
            return self.inner.seek(*at)

        def tell(self):
            return self.inner.tell()

        def readinto(self, into):
            asked.append(len(into))
            return self.inner.readinto(into)

    path = files[1][0]
    opened = store_files.open_file
    monkeypatch.setattr(store_files, "open_file", lambda uri: Counted(opened(uri)))
    metrics = datasource.Metrics(path, 0)
    parts = datasource.spans_of(datasource.Split(path, 0, 1 << 40), metrics=metrics)
    assert sum(b.num_rows for part in parts for b in datasource.read_range(part, 1 << 28, datasource.Predicates(), metrics, ["flag"])) > 2000
    assert metrics.members > 50
    assert len(asked) <= 2 + metrics.compressed_bytes // store_files.READ_AHEAD
