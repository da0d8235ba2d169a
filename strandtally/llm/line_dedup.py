"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A line's key is the line with white space stripped at both ends and A-Z lower-cased. Three
tables hold the state: ``references`` (key, doc_id: each document that holds a key, once),
``counts`` (key, docs, last_doc: how many documents hold it, and the largest id), and ``filters``
(shard, path: a file in the shared folder with a cuckoo filter of the keys that ``min_docs`` or more documents hold). Inserting
documents adds references, deleting takes theirs away; an insertion followed by its deletion gives the state before.
References and counts are kept in layers: a change writes its own rows as a new one, the counts of the keys concerned
follow from those before, and only where a key loses its largest document is the next one looked up in the references. Only keys
that cross ``min_docs`` enter or leave their shard's filter; other shards keep their files. When the number of shared keys outgrows the
shards, all filters are built anew over more of them.

Lines whose key is shared lose all copies but those of the largest doc_id. The filters screen
references before they meet the exact counts: references are dealt out by shard and salt, and each task
reads its own shards' filters, one after another, so filters pass neither the driver nor a broadcast,
and a task holds one at a time. References of one line that very many documents hold are salted in the join too.

Cases: null or empty text is one empty line; keys shorter than ``min_chars`` code points are
never shared; rows with the same id are versions of one document; rows with a null id neither
count nor lose lines; other columns pass through unchanged.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.files import create, open_file
from strandtally.llm.components import SALTS
from strandtally.llm.textscan import give_back, pieces, take_turn
from strandtally.shared import materialize, new_path

STRIP = " \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHARD_KEYS = 200_000
_DROPS = "__line_dedup_drops"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit key of a line; None if it is too short to be shared."""
    line = line.strip(STRIP)
    return xxhash.xxh3_128_digest(line.encode().translate(LOWER)) if len(line) >= min_chars else None


def line_references(docs: DataFrame, doc_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(key, doc_id) of every long line, once for each document."""

    def run(batches):
        take_turn("scan")
        for batch in (p for b in batches for p in pieces(b, 1024)):
            keys, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}
                keys += own
                at += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(pa.array(at, pa.int64()))], ["key", "doc_id"])
        give_back()

    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, f"key binary, doc_id {docs.schema[doc_col].dataType.simpleString()}").distinct()


class CuckooFilter:
    """Buckets of four 16-bit tags; a key lies in one of two buckets. Deleting undoes inserting."""

    SLOTS = 4

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (cls.SLOTS * 0.8)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, "<u2").reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags and both buckets of keys, given as rows of two 64-bit halves."""
        mask = np.uint64(len(self.table) - 1)
        tag = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        first = keys[:, 0] & mask
        return tag, first.astype(np.int64), (first ^ self._step(tag, mask)).astype(np.int64)

    @staticmethod
    def _step(tag: np.ndarray, mask: np.uint64) -> np.ndarray:
        return (tag.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(3)) & mask

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no place; the filter must then be built anew, larger."""
        mask, rng = np.uint64(len(self.table) - 1), np.random.default_rng(0)
        for tag, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = tag
                    break
            else:
                for _ in range(500):
                    slot = rng.integers(self.SLOTS)
                    tag, self.table[bucket, slot] = self.table[bucket, slot], tag
                    bucket = int(np.uint64(bucket) ^ self._step(np.array([tag], np.uint16), mask)[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = tag
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for tag, a, b in zip(*self.places(keys), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == tag)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        tag, a, b = self.places(keys)
        return ((self.table[a] == tag[:, None]) | (self.table[b] == tag[:, None])).any(axis=1)


def _halves(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


_FILTERS = "shard int, path string"


def _save(folder: str, shard: int, made: CuckooFilter) -> pa.Table:
    path = f"{folder}/{shard:08d}-{uuid.uuid4().hex}.cuckoo"
    with create(path) as out:
        out.write(made.dump())
    return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path]})


def load_filter(path: str) -> CuckooFilter:
    with open_file(path) as file:
        return CuckooFilter.load(file.read())


def _build(keys: np.ndarray) -> CuckooFilter:
    n = len(keys)
    while not (made := CuckooFilter.for_keys(n)).insert(keys):
        n = 2 * max(1, n)
    return made


def _filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """A filter for each shard that has keys."""
    folder = new_path(counts.sparkSession, "line-cuckoo")

    def run(table: pa.Table) -> pa.Table:
        return _save(folder, table["shard"][0].as_py(), _build(_halves(table["key"].combine_chunks())))

    keys = _with_shard(counts.where(F.col("docs") >= min_docs).select("key"), shards)
    return materialize(keys.groupBy("shard").applyInArrow(run, _FILTERS), "line-filters")


def _updated(filters: DataFrame, crossed: DataFrame) -> DataFrame:
    """The filters after keys with ``added`` came in and the others left; the path is null where a filter is full."""
    folder = new_path(crossed.sparkSession, "line-cuckoo")

    def run(old: pa.Table, change: pa.Table) -> pa.Table:
        if not change.num_rows:
            return old
        shard, keys, added = change["shard"][0].as_py(), _halves(change["key"].combine_chunks()), change["added"].to_numpy().astype(bool)
        if not old.num_rows:
            return _save(folder, shard, _build(keys[added]))
        made = load_filter(old["path"][0].as_py())
        made.delete(keys[~added])
        return _save(folder, shard, made) if made.insert(keys[added]) else pa.table({"shard": pa.array([shard], pa.int32()), "path": pa.array([None], pa.string())})

    return materialize(filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(run, _FILTERS), "line-filters")


class Layers:
    """A table that grows by layers, each written once and more than twice as large as the one after it.

    A new layer takes in those before it that are no larger than that, so rows are written a number of times that is
    logarithmic in the table, whatever the sizes of the changes. ``merge`` gets the rows of the layers that become one.
    """

    def __init__(self, parts: tuple[tuple[DataFrame, int], ...], label: str):
        self.parts, self.label = parts, label

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.parts)

    def read(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [p for p, _ in self.parts])

    def added(self, new: DataFrame, merge: Callable[[DataFrame, bool], DataFrame]) -> Layers:
        """With the rows of ``new``, a written table; ``merge`` is told whether its layers are all there are."""
        rows = new.count()
        if not rows and self.parts:
            return self
        first, total = len(self.parts), rows
        while first and self.parts[first - 1][1] <= 2 * total:
            first -= 1
            total += self.parts[first][1]
        old, young = self.parts[:first], self.parts[first:]
        if young:
            new = materialize(merge(Layers((*young, (new, rows)), "").read(), first == 0), self.label)
            rows = new.count()
        return Layers((*old, (new, rows)), self.label)


def _newest(counts: DataFrame) -> DataFrame:
    best = counts.groupBy("key").agg(F.max(F.struct("seq", "docs", "last_doc")).alias("best"))
    return best.select("key", "best.docs", "best.last_doc", "best.seq")


@dataclass
class LineIndex:
    """The state of an incremental line deduplication; every change gives a new one, and writes in proportion to itself.

    A change has a number. References carry that of their insertion, ``deleted`` (doc_id, seq) that of a document's
    last deletion, which ends all references before it; of a key's counts the last hold. References that
    have ended are left out as layers merge, and all layers are written anew once they are more than half.
    """

    held: Layers
    counted: Layers
    deleted: Layers | None
    ended: int
    seq: int
    shared: int
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    doc_col: str
    text_col: str

    @classmethod
    def build(cls, docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40) -> LineIndex:
        references = materialize(line_references(docs, doc_col, text_col, min_chars).withColumn("seq", F.lit(0)), "line-references")
        counts = materialize(references.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last_doc")).withColumn("seq", F.lit(0)), "line-counts")
        shared = counts.where(F.col("docs") >= min_docs).count()
        held, counted = (Layers(((t, t.count()),), name) for t, name in ((references, "line-references"), (counts, "line-counts")))
        return cls(held, counted, None, 0, 0, shared, _filters(counts, min_docs, _shards(shared)), _shards(shared), min_docs, min_chars, doc_col, text_col)

    def _live(self, references: DataFrame) -> DataFrame:
        """References that no later deletion has ended."""
        if self.deleted is None:
            return references
        ends = self.deleted.read().groupBy(F.col("doc_id").alias("gone")).agg(F.max("seq").alias("end"))
        return references.join(ends, F.col("doc_id") == F.col("gone"), "left").where("end is null or seq > end").drop("gone", "end")

    @property
    def references(self) -> DataFrame:
        return self._live(self.held.read()).select("key", "doc_id")

    @property
    def counts(self) -> DataFrame:
        rows = self.counted.read()
        return (_newest(rows).where("docs > 0") if len(self.counted.parts) > 1 else rows).select("key", "docs", "last_doc")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The state with these documents in as well; what is there already is not added again."""
        new = materialize(line_references(docs, self.doc_col, self.text_col, self.min_chars), "line-new")
        known = self.references.join(new, ["key", "doc_id"], "left_semi")
        new = materialize(new.join(known, ["key", "doc_id"], "left_anti").withColumn("seq", F.lit(self.seq + 1)), "line-references")
        touched = self._with_counts(new).selectExpr("key", "was", "was + n as docs", "greatest(last_was, last_new) as last_doc")
        held = self.held.added(new, lambda rows, _: self._live(rows))
        ended = self.ended - (self.held.rows + new.count() - held.rows)
        return self._changed(touched, held=held, ended=ended)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The state without the documents of these ids (first column); ids that it has not, and nulls, change nothing."""
        ids = materialize(doc_ids.select(F.col(doc_ids.columns[0]).alias("doc_id")).where("doc_id is not null").distinct(), "line-ids")
        gone = materialize(self.references.join(ids, "doc_id", "left_semi").select("key", "doc_id"), "line-gone")
        less = materialize(self._with_counts(gone), "line-less")
        # only keys that lose their largest document look for the next one
        headless = less.where("last_new = last_was and was > n").select("key")
        left = self.references.join(headless, "key", "left_semi").join(ids, "doc_id", "left_anti")
        heads = left.groupBy("key").agg(F.max("doc_id").alias("head"))
        touched = less.join(heads, "key", "left").selectExpr("key", "was", "was - n as docs", "coalesce(head, last_was) as last_doc")
        seq = F.lit(self.seq + 1)
        ends = materialize(gone.select("doc_id").distinct().withColumn("seq", seq), "line-deleted")
        last = lambda rows, _: rows.groupBy("doc_id").agg(F.max("seq").alias("seq"))
        deleted = (self.deleted or Layers((), "line-deleted")).added(ends, last)
        out = self._changed(touched, deleted=deleted, ended=self.ended + gone.count())
        if 2 * out.ended > out.held.rows:
            all_left = materialize(out._live(out.held.read()), "line-references")
            out = replace(out, held=Layers(((all_left, all_left.count()),), out.held.label), deleted=None, ended=0)
        return out

    def _with_counts(self, change: DataFrame) -> DataFrame:
        """(key, n, last_new, was, last_was): references of the change by key, and the counts before it."""
        by_key = change.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_new"))
        before = _newest(self.counted.read().join(change.select("key").distinct(), "key", "left_semi"))
        return by_key.join(before.selectExpr("key", "docs as was", "if(docs > 0, last_doc, null) as last_was"), "key", "left").fillna(0, ["was"])

    def _changed(self, touched: DataFrame, **state) -> LineIndex:
        """``touched``: key, was, docs, last_doc of each key whose number of documents changes."""
        touched = materialize(touched.withColumn("seq", F.lit(self.seq + 1)), "line-counts")
        counted = self.counted.added(touched.drop("was"), lambda rows, all_there: _newest(rows).where("docs > 0") if all_there else _newest(rows))
        crossed = touched.select("key", (F.col("docs") >= self.min_docs).alias("added"), (F.col("was") >= self.min_docs).alias("before")).where("added <> before").drop("before")
        shared = self.shared + sum(r["count"] * (1 if r.added else -1) for r in crossed.groupBy("added").count().collect())
        out = replace(self, counted=counted, seq=self.seq + 1, shared=shared, **state)
        needed, full = _shards(shared), False
        if self.shards // 4 < needed <= 2 * self.shards:
            out.filters = _updated(self.filters, _with_shard(crossed, self.shards))
            full = out.filters.where("path is null").limit(1).count() > 0
        else:
            out.shards, full = needed, True
        if full:
            out.filters = _filters(out.counts, self.min_docs, out.shards)
        return out

    def screened(self) -> DataFrame:
        """The references whose key the filters have, and few others."""
        salted = _with_shard(self.references, self.shards).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        filters = self.filters.select(F.col("shard").alias("shard2"), "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
        dealt = salted.join(filters, (F.col("shard") == F.col("shard2")) & (F.col("salt") == F.col("salt2"))).select("key", "doc_id", "path")

        def run(batches):
            path, made = None, None
            for batch in batches:
                paths = batch.column(2).dictionary_encode()
                which, keep = paths.indices.to_numpy(), np.zeros(batch.num_rows, bool)
                keys = _halves(batch.column(0))
                for i, p in enumerate(paths.dictionary.to_pylist()):
                    if p != path:
                        path, made = p, load_filter(p)
                    own = np.flatnonzero(which == i)
                    keep[own] = made.contains(keys[own])
                yield batch.select(["key", "doc_id"]).filter(pa.array(keep))

        return dealt.mapInArrow(run, self.references.select("key", "doc_id").schema)

    def drops(self) -> DataFrame:
        """(doc_id, keys): what each document loses."""
        shared = self.counts.where(F.col("docs") >= self.min_docs).select(F.col("key").alias("key2"), "last_doc")
        lines = materialize(self.screened().withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "line-screened")
        # a line of very many documents is spread over slots; only slots that occur get its count
        slots = lines.select("key", "slot").distinct().join(shared, F.col("key") == F.col("key2")).select("key2", F.col("slot").alias("slot2"), "last_doc")
        found = lines.join(slots, (F.col("key") == F.col("key2")) & (F.col("slot") == F.col("slot2"))).where("doc_id < last_doc")
        return found.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """The documents without the lines they lose; adds ``n_lines`` (before) and ``n_dropped``."""
        min_chars = self.min_chars

        @F.arrow_udf("struct<text: string, n_lines: long, n_dropped: long>")
        def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
            kept, lines, dropped = [], [], []
            for text, keys in ((t.as_py(), k.as_py()) for t, k in zip(texts, drops, strict=True)):
                own = (text or "").split("\n")
                lines.append(len(own))
                if keys:
                    keys = set(keys)
                    left = [x for x in own if line_key(x, min_chars) not in keys]
                    dropped.append(len(own) - len(left))
                    kept.append("\n".join(left))
                else:
                    dropped.append(0)
                    kept.append(text)
            return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

        # so marked, it is not run again for a filter on its result
        cut = cut.asNondeterministic()
        drops = self.drops().select(F.col("doc_id").alias("__line_dedup_doc"), F.col("keys").alias(_DROPS))
        out = docs.join(drops, docs[self.doc_col] == F.col("__line_dedup_doc"), "left").withColumn("__line_dedup", cut(F.col(self.text_col).cast("string"), F.col(_DROPS)))
        keep = [F.col("__line_dedup.text").alias(c) if c == self.text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
        return out.select(*keep, "__line_dedup.n_lines", "__line_dedup.n_dropped")


def _shards(shared: int) -> int:
    return max(1, -(-shared // SHARD_KEYS))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = LineIndex.build(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with l as (select doc_id, text, unnest(range(1, len(a) + 1)) as i, unnest(a) as line from (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as a from documents)),
k as (select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as last_doc from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, s.key is not null and k.doc_id < s.last_doc as gone from k left join s using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id"""
