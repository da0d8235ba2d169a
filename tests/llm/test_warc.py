import hashlib
import io

import pytest

from strandtally.llm import warc


def archive(spark, pages, chunk_bytes, **kw):
    known = warc.revisits(pages, "doc_id", "text")
    chunks = warc.payload_chunks(pages, known, "doc_id", "text", None, chunk_bytes)
    return warc.read_archives(warc.write_archives(chunks), chunk_bytes, **kw)


@pytest.mark.parametrize("chunk_bytes", [7, 1 << 20])
def test_round_trip_of_chunks(spark, nasty, chunk_bytes):
    rows = archive(spark, nasty, chunk_bytes).toPandas()
    assert rows.data.map(len).max() <= chunk_bytes
    want = {}
    for r in nasty.select("doc_id", "text").collect():
        want.setdefault((r.text or "").encode(), []).append(r.doc_id)
    payloads = {}
    for r in rows[rows.record_type == "response"].itertuples():
        payloads.setdefault((r.record_id, r.digest_so_far if r.last else None), None)
    assert rows["last"].sum() == nasty.count()
    by_digest = {warc.base32(hashlib.sha1(p).digest()): (len(p), ids) for p, ids in want.items()}
    for r in rows[rows["last"]].itertuples():
        size, ids = by_digest[r.digest_so_far]
        assert r.bytes_so_far == size
        least = min((i for i in ids if i is not None), default=None)
        own = None if r.record_id is None else int(r.record_id)
        if r.record_type == "revisit":
            assert int(r.refers_to) == least < own
        else:
            assert own is None or own == least


def test_running_digest(spark):
    pages = spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string")
    rows = archive(spark, pages, 4).orderBy("chunk_no").collect()
    assert [bytes(r.data) for r in rows] == [b"abcd", b"efgh", b"ij"]
    assert [r.bytes_so_far for r in rows] == [4, 8, 10]
    assert [r.digest_so_far for r in rows] == [warc.base32(hashlib.sha1(b"abcdefghij"[:n]).digest()) for n in (4, 8, 10)]
    assert [r.last for r in rows] == [False, False, True]


def test_repeated_rows_and_null_ids_of_many_chunks(spark):
    """Chunks of equal rows do not mix; null ids of equal payload are responses, in whatever file they are."""
    rows = [(5, "abcdefghij" * 9)] * 3 + [(7, "abcdefghij" * 9)] + [(None, "abcdefghij" * 9)] * 4 + [(None, "x" * 30), (None, None)]
    out = archive(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 7).where("last").collect()
    want = lambda text: warc.base32(hashlib.sha1(text.encode()).digest())
    assert sorted((r.record_id or "", r.record_type, r.refers_to or "", r.bytes_so_far) for r in out) == [("", "response", "", 0), ("", "response", "", 30)] + [("", "response", "", 90)] * 4 + [("5", "response", "", 90)] * 3 + [("7", "revisit", "5", 90)]
    assert {r.digest_so_far for r in out} == {want("abcdefghij" * 9), want("x" * 30), want("")}


def test_chunks_are_cut_before_the_shuffle(spark):
    """No whole payload is shuffled or sorted: below every exchange and sort of payloads stands the cut."""
    pages = spark.createDataFrame([(1, "ab" * 50)], "doc_id long, text string")
    plan = warc.payload_chunks(pages, warc.revisits(pages, "doc_id", "text"), "doc_id", "text", None, 7)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    cut = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("Exchange" in x for x in lines[:cut])
    assert not any("Exchange" in x or "Sort" in x for x in lines[cut : next(i for i, x in enumerate(lines) if i > cut and "Scan" in x)])


def test_archive_cut_inside_a_member(spark, tmp_path):
    pages = spark.createDataFrame([(1, "ab" * 5000), (2, "cd" * 5000)], "doc_id long, text string").coalesce(1)
    chunks = warc.payload_chunks(pages, warc.revisits(pages, "doc_id", "text"), "doc_id", "text", None)
    paths = [r.path for r in warc.write_archives(chunks, str(tmp_path)).collect()]
    with open(paths[0], "rb") as f:
        data = f.read()
    assert list(warc.records(io.BytesIO(data)))
    begins = [i for i in range(len(data)) if data[i : i + 3] == b"\x1f\x8b\x08"]
    for at in {begins[-1] + 1, begins[-1] + 12, len(data) - 9, len(data) - 1}:
        with pytest.raises(ValueError, match="an archive ends within"):
            list(warc.records(io.BytesIO(data[:at])))


def test_empty_table(spark, empty):
    assert archive(spark, empty, 100).count() == 0


def test_broken_archive():
    with pytest.raises(Exception):  # noqa: B017
        list(warc.records(io.BytesIO(b"\x1f\x8b broken")))
