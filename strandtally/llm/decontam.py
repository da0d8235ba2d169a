"""Benchmark decontamination by winnowing.

Both sides are cut into words. A window is ``window`` consecutive words of a benchmark item; an
item of fewer words is one window. Every window is represented by its smallest ``gram``-word
hash. A document keeps a hash wherever it is the smallest of the ``window - gram + 1`` hashes of
some window that lies inside the document, so any window that both sides share gives both the
same fingerprint: no shared span of ``window`` words can be missed. Each fingerprint of a document is extended to the windows
whose smallest hash it is; fingerprints are joined together with the hash of the whole window, so that a frequent
fingerprint does not multiply, and each hit is compared word by word.

Items shorter than a window are looked up under a hash of all their words instead.

Before the join, documents drop fingerprints that no item can have, by a bitmap of sixteen bits for each window of the benchmark,
and at least 2 ** 20 and at most 2 ** 28 bits (32 MB) in all; it never drops a true hit.

Cases: null or empty text has no words; a null item id is skipped; rows with the same id count
as versions of one document and share their hits; rows with a null ``doc_id`` stay and count as
clean; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.llm.components import salted_join
from strandtally.llm.textscan import ALNUM_WORDS, Words, mix, scan, take_turn
from strandtally.shared import materialize

_HITS = "array<struct<fp: long, whole: long, start: int, words: array<string>>>"
FILTER_BITS = (20, 28)


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one text."""
    h, n = words.hash, len(words.start)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = mix(out ^ h[j : n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
    return out, words.text[k - 1 :] == words.text[: n - k + 1]


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    out = values[: len(values) - size + 1].copy()
    for j in range(1, size):
        best(out, values[j : len(values) - size + 1 + j], out=out)
    return out


def winnow(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows inside a text, and the smallest gram hash of each, which is the fingerprint that is kept for it."""
    h, _ = gram_hashes(words, gram)
    span = window - gram + 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(words.text[window - 1 :] == words.text[: len(words.text) - window + 1])
    return inside, _sliding(h, span, np.minimum)[inside]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, gram: int, window: int) -> DataFrame:
    """One row per item and window: its fingerprint, the hash of the whole window, and the words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for words in scan(batch.column(1), ALNUM_WORDS):
                at, lowest = winnow(words, gram, window)
                fps, whole = dict(zip(at.tolist(), lowest.tolist(), strict=True)), gram_hashes(words, window)[0]
                rows = []
                for t in range(words.n_texts):
                    lo, hi = words.bounds[t], words.bounds[t + 1]
                    if lo == hi:
                        continue
                    item = ids[words.first + t].as_py()
                    if hi - lo < window:
                        fp = gram_hashes(words, int(hi - lo))[0][lo]
                        rows.append((item, fp, fp, [words.word(i).decode() for i in range(lo, hi)]))
                        continue
                    for a in range(lo, hi - window + 1):
                        rows.append((item, fps[a], whole[a], [words.word(i).decode() for i in range(a, a + window)]))
                if rows:
                    item, fp, all_of_it, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), _signed(np.array(fp, np.uint64)), _signed(np.array(all_of_it, np.uint64)), pa.array(text, pa.list_(pa.string()))], ["item_id", "fp", "whole", "words"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null")
    return items.mapInArrow(run, "item_id string, fp long, whole long, words array<string>")


def scan_documents(docs: DataFrame, doc_col: str, text_col: str, gram: int, window: int, bitmap, filter_bits: int, short: list[int]) -> DataFrame:
    """One row per document with its number of words and the windows whose fingerprint some item may share."""
    doc_type = docs.schema[doc_col].dataType.simpleString()

    def run(batches):
        take_turn("scan")
        bits, cut = np.frombuffer(bitmap.value, np.uint8), np.uint64((1 << filter_bits) - 1)

        def known(h: np.ndarray) -> np.ndarray:
            cell = (h & cut).astype(np.int64)
            return np.flatnonzero(bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)

        for batch in batches:
            ids = batch.column(0)
            for words in scan(batch.column(1), ALNUM_WORDS):
                at, fp = winnow(words, gram, window)
                near = known(fp)
                at, fp = at[near], fp[near]
                found = [(at, fp, gram_hashes(words, window)[0][at] if len(at) else fp, np.full(len(at), window))]
                for k in short:
                    h, inside = gram_hashes(words, k)
                    near = known(h)
                    near = near[inside[near]]
                    found.append((near, h[near], h[near], np.full(len(near), k)))
                at, fp, whole, size = (np.concatenate(x) for x in zip(*found, strict=True))
                hits: list[list] = [[] for _ in range(words.n_texts)]
                for a, f, w, k in zip(at.tolist(), fp.view(np.int64).tolist(), whole.view(np.int64).tolist(), size.tolist(), strict=True):
                    t = int(words.text[a])
                    hits[t].append({"fp": f, "whole": w, "start": a - int(words.bounds[t]), "words": [words.word(i).decode() for i in range(a, a + k)]})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(words.first, words.n_texts), pa.array(np.diff(words.bounds)), pa.array(hits, pa.list_(pa.struct([("fp", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.string()))])))],
                    ["doc_id", "n_words", "hits"],
                )

    return docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {doc_type}, n_words long, hits {_HITS}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted array of item ids as strings).

    ``n_hit`` counts the document's words inside any occurrence of any window.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    occurrences = materialize(benchmark_windows(benchmark, item_col, item_text_col, gram, window).withColumn("win", F.sha2(F.concat_ws(" ", "words"), 256)), "bench-windows")
    filter_bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * occurrences.count()).bit_length()))
    # at most 2 ** filter_bits bits, gathered in words of 64, and at most `window` lengths reach the driver
    cells = occurrences.select(F.expr(f"fp & {(1 << filter_bits) - 1}").alias("cell"))
    found = cells.groupBy(F.expr("shiftright(cell, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros((1 << filter_bits) // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    short = sorted(r[0] for r in occurrences.select(F.size("words").alias("n")).where(F.col("n") < window).distinct().collect())
    scanned = materialize(scan_documents(docs, doc_col, text_col, gram, window, spark.sparkContext.broadcast(bitmap.tobytes()), filter_bits, short), "bench-hits")

    windows = occurrences.select("fp", "whole", "words", "win").dropDuplicates(["win"])
    hits = scanned.where("doc_id is not null and size(hits) > 0").select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
    # a window that very many documents have is dealt out by document, here and below
    spans = salted_join(hits, windows, ["fp", "whole", "words"], "doc_id")
    spans = spans.select("doc_id", "start", (F.col("start") + F.size("words")).alias("end"), "win").distinct()
    spans = materialize(spans, "bench-spans")

    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
        .withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    )
    items = salted_join(spans.select("doc_id", "win").distinct(), occurrences.select("win", "item_id").distinct(), ["win"], "doc_id", seen=spans).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return (
        scanned.select("doc_id", "n_words").join(covered, "doc_id", "left").join(items, "doc_id", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _sql() -> str:
    """The same by brute force: every window of every item against every window of every document."""
    words = lambda t, i: f"select {i} as id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from {t}"
    return f"""
with d as ({words("documents", "doc_id")}), b as ({words("benchmark", "item_id")}),
bw as (select id as item, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as win from b where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
hit as (select dw.id, i, dw.n, item from (select id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from dw) dw join bw on dw.win = bw.win and dw.n = bw.n),
covered as (select id, count(distinct p) as n_hit from (select distinct id, unnest(range(i, i + n)) as p from hit) group by id),
items as (select id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct id, cast(item as varchar) as item from hit) group by id)
select d.id as doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (id) left join items using (id)"""


SQL = _sql()
