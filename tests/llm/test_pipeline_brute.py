"""The whole pipeline against a plain version of each stage, and on odd tables."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strandtally.llm.language_id import profile
from strandtally.llm.packing import byte_bpe_path, piece_lengths
from tests.conftest import SF
from tests.llm.test_decontam import brute as plain_hits
from tests.llm.test_near_dup import plain_groups
from tests.llm.test_packing import plain_ids


def plain_language(rows):
    vectors = [profile(r["text"]) for r in rows]
    sums = {}
    for r, v in zip(rows, vectors, strict=True):
        if r["lang"] is not None and v is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v
    units = [v / np.linalg.norm(v) for v in sums.values()]
    return [r for r, v in zip(rows, vectors, strict=True) if v is not None and max(float(u @ v) for u in units) / np.linalg.norm(v) >= corpus_pipeline.LEAST_SCORE]


def plain_lines(rows, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(r["doc_id"])
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or r["doc_id"] == max(held[key(x)])]
        text = "\n".join(kept)
        if len(kept) == len(lines) or text.strip(" "):
            out.append({**r, "text": text})
    return out


def plain_pipeline(rows, bench):
    rows = plain_lines(plain_language(rows))
    group = plain_groups([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    hit = {doc for doc, _, n, _ in plain_hits([(r["doc_id"], r["text"]) for r in rows], bench) if n}
    tokenizer = Tokenizer.from_file(byte_bpe_path())
    out = []
    for r in rows:
        if r["doc_id"] not in hit:
            ids, start = plain_ids(r["text"], tokenizer), 0
            for n in piece_lengths(len(ids), 2048):
                out.append((r["doc_id"], start, n, zlib.crc32(ids[start : start + n].tobytes())))
                start += n
    return sorted(out)


@pytest.mark.parametrize("where", ["doc_id >= 0", "doc_id % 2 = 0"])
def test_run_against_plain_stages(spark, tmp_path, where):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").where(where), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_pipeline([r.asDict() for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert 0 < len({g[0] for g in got}) < docs.count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a text without an id, but with words enough", "en", None, None), (3, "some words in a short text", "en", "s", 26)]])
def test_empty_tables_and_nulls(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows if r[1]}
