"""Anchors, batches and offset translation on small relations."""

import pytest

from strandtally.plans import spans


def test_anchors_drop_repeats_and_keep_ends(spark):
    ends = spark.createDataFrame([(0, 10, 40), (1, 5, 6)], "file_id int, first_record long, data_end long")
    entries = spark.createDataFrame([(0, 20), (0, 20), (0, 30), (0, 0), (0, 40), (0, 55)], "file_id int, packed long")
    got = spans.anchors(ends, entries)
    assert [(r.file_id, r.anchor_id, r.packed) for r in got.orderBy("file_id", "packed").collect()] == [(0, 0, 10), (0, 1, 20), (0, 2, 30), (0, 3, 40), (1, 0, 5), (1, 1, 6)]
    bounds = spans.span_bounds(got)
    assert bounds.count() == 4
    assert spans.check_spans(bounds).count() == 0


def test_shared_member(spark):
    """Two members of ten bytes, batches of at most twelve: the member at the cut is in both."""
    members = spark.createDataFrame([(0, 0, 10), (0, 100, 10)], "file_id int, compressed_offset long, uncompressed_len long")
    packed = [2, 6, 100 << 16 | 3, 100 << 16 | 8]
    anchored = spark.createDataFrame([(0, i, p) for i, p in enumerate(packed)], "file_id int, anchor_id long, packed long")
    placed = spans.anchor_members(anchored, spans.member_positions(members)).select("file_id", "position")
    batches = spans.batch_plan(placed, 12)
    assert sorted(r.batch_start for r in batches.collect()) == [2, 13]
    last = spark.createDataFrame([(0, 18)], "file_id int, data_end long")
    mapped = spans.block_map(batches, spans.member_positions(members), last)
    assert sorted(tuple(r)[1:] for r in mapped.collect()) == [(2, 0, 2, 10, 0, 8), (2, 100, 0, 3, 8, 11), (13, 100, 3, 8, 0, 5)]
    places = {r.packed: (r.batch_start, r.batch_offset) for r in spans.translate(anchored, mapped).collect()}
    assert places == {2: (2, 0), 6: (2, 4), packed[2]: (2, 11), packed[3]: (13, 5)}


@pytest.mark.parametrize("cap", [7, 20, 1000])
def test_batches_are_greedy(spark, cap):
    positions = [0, 3, 4, 9, 15, 16, 22, 29, 30, 36, 41]
    want, at = [], 0
    while at < positions[-1]:
        want.append(at)
        at = max(p for p in positions if p - at <= cap)
    got = spans.batch_plan(spark.createDataFrame([(0, p) for p in positions], "file_id int, position long"), cap)
    assert sorted(r.batch_start for r in got.collect()) == want


def test_span_over_cap(spark):
    with pytest.raises(ValueError, match="exceeds the configured"):
        spans.batch_plan(spark.createDataFrame([(0, 0), (0, 9)], "file_id int, position long"), 3)
