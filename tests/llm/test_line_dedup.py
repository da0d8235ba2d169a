import hashlib
import random

import numpy as np

from strandtally.llm import line_dedup
from strandtally.llm.line_dedup import CuckooFilter, LineIndex, load_filter

LONG = ["a line that is long enough to be compared with others, number %d" % i for i in range(12)]


def brute(rows, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or i == max(held[key(x)])]
        out.append((i or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def digests(index, docs):
    return sorted((r.doc_id or 0, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in index.apply(docs).collect())


def corpus(seed, first, n):
    r = random.Random(seed)
    lines = [*LONG, "  " + LONG[0].upper() + "\t", "short", "", "ÀÉ" * 30]
    return [(first + i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 8)))) for i in range(n)]


def test_against_brute_force(spark, nasty):
    rows = corpus(1, 100, 40) + [(None, "\n".join(LONG)), (None, None), (120, LONG[1] + "\n" + LONG[1])]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "doc_id long, text string, key string, n_lines string, n_dropped string")
    assert digests(LineIndex.build(docs), docs) == brute(rows)
    rows = [tuple(r) for r in nasty.select("doc_id", "text").collect()]
    assert digests(LineIndex.build(nasty), nasty) == brute(rows)


def tables(index):
    return sorted(map(tuple, index.counts.collect())), sorted((r.shard, int((load_filter(r.path).table > 0).sum())) for r in index.filters.collect()), index.references.count()


def test_insertion_and_deletion_undo_each_other(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old, new = corpus(1, 0, 30), corpus(2, 100, 30)
    start = LineIndex.build(frame(old))
    both = start.insert(frame(new))
    assert digests(both, frame(old + new)) == brute(old + new)
    assert tables(both)[0] == tables(LineIndex.build(frame(old + new)))[0]
    back = both.delete(frame(new).select("doc_id"))
    assert tables(back) == tables(start)
    assert digests(back, frame(old)) == brute(old)


def test_many_shards(spark, monkeypatch):
    """Filters of few keys each: built, used, outgrown by an insertion, and shrunk by its deletion."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old = corpus(1, 0, 40)
    start = LineIndex.build(frame(old))
    assert start.shards > 4
    assert start.filters.count() > 3
    kept = start.screened().select("key").distinct().count()
    assert start.counts.where("docs >= 5").count() <= kept < start.counts.count()
    assert digests(start, frame(old)) == brute(old)
    many = [(1000 + i, "\n".join(f"one of a great many lines that are new to all of this, {(i + j) % 60}" for j in range(20))) for i in range(60)]
    both = start.insert(frame(many))
    assert both.shards > 2 * start.shards
    assert digests(both, frame(old + many)) == brute(old + many)
    assert digests(both.delete(frame(many).select("doc_id")), frame(old)) == brute(old)


def test_history_of_changes(spark):
    """Insertions, deletions, repeated insertions and unknown ids, against the documents that are left."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda values: spark.createDataFrame([(v,) for v in values], "doc_id long")
    r, now = random.Random(5), dict(corpus(3, 0, 25))
    index = LineIndex.build(frame(list(now.items())))
    for step in range(3):
        rows = corpus(10 + step, 100 * step, 6)
        fresh = [x for x in rows if x[0] not in now]
        # documents that are there already come again, one of them twice
        index = index.insert(frame(fresh + [(i, now[i]) for i in sorted(now)[:3]] + [fresh[0]] if fresh else rows[:0]))
        now.update(fresh)
        gone = [*r.sample(sorted(now), 9), max(now)]
        index = index.delete(ids([*gone, 10_000 + step, None]))
        for i in gone:
            now.pop(i, None)
        fresh_build = LineIndex.build(frame(sorted(now.items())))
        assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, fresh_build.counts.collect()))
        assert index.references.count() == fresh_build.references.count()
    assert digests(index, frame(sorted(now.items()))) == brute(sorted(now.items()))
    nothing = index.delete(ids(sorted(now)))
    assert nothing.references.count() == nothing.counts.count() == nothing.shared == 0
    again = nothing.insert(frame(sorted(now.items())))
    assert digests(again, frame(sorted(now.items()))) == brute(sorted(now.items()))


def test_a_change_writes_in_proportion_to_itself(spark, monkeypatch):
    written, plain = [], line_dedup.materialize

    def counting(df, label):
        out = plain(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counting)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    line = lambda i, j: f"line {j} of document {i} is long enough to be compared with others"
    index = LineIndex.build(frame([(i, "\n".join([LONG[i % 12], *(line(i, j) for j in range(40))])) for i in range(500)]))
    assert index.held.rows == 500 * 41
    written.clear()
    for step in range(4):
        new = frame([(1000 + step, "\n".join([LONG[0], *(line(1000 + step, j) for j in range(9))]))])
        index = index.insert(new)
    index = index.delete(spark.createDataFrame([(0,), (1001,), (77_777,)], "doc_id long"))
    # 40 references come and 51 go; each is written a few times, the 20,500 that stay are not
    assert sum(written) < 12 * 91
    assert index.references.count() == 500 * 41 + 40 - 51
    assert {r.docs for r in index.counts.where("docs > 1").collect()} == {42, 41, 44}


def test_other_columns_and_empty_table(spark, nasty, empty):
    out = LineIndex.build(nasty).apply(nasty)
    assert [c for c in nasty.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"] == out.columns
    assert LineIndex.build(empty).apply(empty).count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(0).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    made = CuckooFilter.for_keys(4000)
    assert made.insert(keys[:4000])
    assert made.contains(keys[:4000]).all()
    assert made.contains(keys[4000:]).mean() < 0.01
    made.delete(keys[:2000])
    assert CuckooFilter.load(made.dump()).contains(keys[2000:4000]).all()
    assert made.contains(keys[:2000]).mean() < 0.01
    made.delete(keys[2000:4000])
    assert not made.table.any()
