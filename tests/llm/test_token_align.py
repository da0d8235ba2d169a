"""Alignment of two tokenizers against whole texts encoded one by one."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from strandtally.llm import token_align as ta

from tests.conftest import SF
from tests.llm.conftest import rng_text

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", "a\nb", "a \n b", " lead", "\nlead", "trail ", "trail\n\n", "tab\tx", "\x00 nul \x00", "▁x ▁", "<|endoftext|> <s> </s> <unk> <0x41>", "é é äö",
    "　wide nbsp line", "\U0001f600 \U0001f468‍\U0001f469 z", "it's we're I'll", "\r\nwin\r\ndows", "x" * 4000, "12345 6789 0", "a b\n c", "中文 日本", "_ _ __ ½ ²",
]


def brute(texts):
    """The contract, by whole texts and ranges of bytes."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    # the byte-level alphabet as its authors give it
    bs = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    cs, n = bs[:], 0
    for b in range(256):
        if b not in bs:
            bs.append(b)
            cs.append(256 + n)
            n += 1
    letters = {chr(c): b for b, c in zip(bs, cs, strict=True)}
    out, documents = [], Counter()
    for text in texts:
        row = None
        if text:
            want = (" " + text).encode()
            a_ids, b_ids = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_tok = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a_ids]
            pieces = [b_model.id_to_piece(i) for i in b_ids]
            b_tok = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(a_tok) == want and b"".join(b_tok) == want:
                spans = lambda toks: [(int(e) - len(t), int(e)) for t, e in zip(toks, np.cumsum([len(t) for t in toks]), strict=True)]
                sa, sb = spans(a_tok), spans(b_tok)
                links, j = [], 0
                for i, (s, e) in enumerate(sa):
                    while sb[j][1] <= s:
                        j += 1
                    k = j
                    while k < len(sb) and sb[k][0] < e:
                        links.append((a_ids[i], b_ids[k]))
                        k += 1
                cuts = sorted({e for _, e in sa} & {e for _, e in sb})
                begins = [0, *cuts[:-1]]
                group = lambda ids, sp, x, y: ",".join(str(t) for t, (s, e) in zip(ids, sp, strict=True) if s >= x and e <= y)
                text_of = ";".join(f"{group(a_ids, sa, x, y)}|{group(b_ids, sb, x, y)}" for x, y in zip(begins, cuts, strict=True)) if len(want) < 9000 else None
                row = (len(a_ids), len(b_ids), len(cuts), links, text_of)
                documents.update(set(links))
        out.append(row)
    top = defaultdict(int)
    for (a, _), c in documents.items():
        top[a] = max(top[a], c)
    full = []
    for row in out:
        if row is None:
            full.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_g, links, text_of = row
        full.append((n_a, n_b, n_g, len(links), sum(documents[x] == top[x[0]] for x in links), sum(documents[x] for x in links), text_of and hashlib.sha256(text_of.encode()).hexdigest()))
    return full


def got_rows(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: tuple(r)[1:] for r in ta.align(frame, A, B).collect()}
    return [rows[i] for i in range(len(texts))]


def check(got, want):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        assert g[:-1] == w[:-1], (i, g, w)
        if w[-1] is not None:
            assert g[-1] == w[-1], i


@pytest.mark.parametrize("entries", [50, ta.BLOCK_ENTRIES])
def test_brute_force(spark, monkeypatch, entries):
    texts = [*ODD, None, "", *ODD[:5], rng_text(3, 20_000), *[rng_text(s, 60) for s in range(40)], *["one text many times"] * 30, "word" * 3 + "\n" + rng_text(9, 500).replace(" w1", "\nw1")]
    check(got_rows(spark, texts), brute(texts))


def test_small_blocks_and_memory(monkeypatch):
    """Blocks cut by documents or entries, and a memory that is too small, change nothing."""
    texts = [*ODD, *[rng_text(s, 60) for s in range(20)]]
    whole = ta.Aligner(A, B)
    monkeypatch.setattr(ta, "MEMORY", 10)
    small = ta.Aligner(A, B)
    want = whole.align(texts)
    for i, t in enumerate(texts):
        totals, hashes, *_ = small.align([t])
        assert totals[0].tolist() == want[0][i].tolist()
        assert hashes[0] == want[1][i]


def test_query_on_table(spark):
    from strandtally.llm.registry import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted((r.doc_id, *tuple(r)[1:]) for r in QUERIES["op12_token_align"](spark, SF).collect())
    check([r[1:] for r in rows], brute([r.text for r in sorted(docs)]))


def test_odd_tables(spark, nasty, empty):
    out = ta.align(nasty, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = out.collect()
    texts = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    want = brute([t for _, t in texts])
    key = lambda x: tuple((v is not None, v) for v in x)
    short = lambda x: key(x[:-1])
    assert sorted(map(short, map(tuple, rows))) == sorted(short((i, *w)) for (i, _), w in zip(texts, want, strict=True))
    assert ta.align(empty, A, B).collect() == []


@pytest.mark.parametrize("size", [8, 100, 65536])
def test_bitmaps(size):
    r = np.random.default_rng(size)
    for n in {1, 3, size // 20 + 1, size // 2, size}:
        docs = np.sort(r.choice(size, n, replace=False))
        assert ta.unpack_docs(ta.pack_docs(docs, size), n).tolist() == docs.tolist()
        for high in (1, 2, 300):
            links = r.integers(1, high + 1, n)
            assert ta.unpack_planes(ta.pack_planes(links), n).tolist() == links.tolist()


def test_counts_of_pairs(spark):
    """The counts by id pair: documents by popcount, links by planes."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat the cat", "the dog", "a cat the"])], "doc_id long, text string")
    scanned = ta.scan(frame, A, B)
    posts = scanned.where("a is not null")
    rows = ta.pair_counts(posts).collect()
    assert sum(r.all_links for r in rows) == scanned.agg({"n_links": "sum"}).first()[0]
    assert max(r.documents for r in rows) == 3
