import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandtally.llm import packing
from strandtally.llm.encode import Encoder
from tests.conftest import SF
from tests.llm.conftest import rng_text


def plain_ids(text, tokenizer):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packs_every_id_once(spark, nasty, tokenizer, capacity):
    packed = packing.pack_documents(nasty, packing.byte_bpe_path(), 1, capacity=capacity, keep_ids=True)
    rows = packed.toPandas()
    by_sequence = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    want = [plain_ids(r.text, tokenizer) for r in nasty.select("text").collect()]
    assert rows.length.sum() == sum(map(len, want))
    have = {(len(w), zlib.crc32(w.tobytes())) for w in want}
    for r in rows.itertuples():
        assert list(r.ids) == by_sequence[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
        assert s.length.sum() <= capacity
    whole = rows[(rows.length == rows.doc_tokens)]
    assert {(r.length, r.ids_crc32) for r in whole.itertuples()} <= have


def test_pieces_are_reciprocals():
    for n in range(1, 5000):
        pieces = packing.piece_lengths(n, 2048)
        assert sum(pieces) == n
        assert all(2048 // (2048 // p) == p for p in pieces)


def test_little_padding(spark):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(400)], "doc_id long, text string")
    rows = packing.pack_documents(docs, packing.byte_bpe_path(), 1).toPandas()
    full = rows.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in full)
    assert padding < 0.03 * full.sum()


def test_empty_table(spark, empty):
    assert packing.pack_documents(empty, packing.byte_bpe_path(), 1).count() == 0


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_remembered_segments_change_nothing(name, spaced):
    """Ids of any text are those of the tokenizer on the whole text, with its added tokens in text in any case."""
    import random

    path = public_tokenizers.path(name)
    made, plain, r = Encoder(path, spaced), Tokenizer.from_file(path), random.Random(3)
    odd = [*" \n\t.,'|aAbé1sＡ \u0301\r\x1c\xa0ΣσİǅX!?$*", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|"]
    even = ["abc", "Word", "é", "ÄßX", "Σ", "ıİ", "ª", " ", " ", "\n", ".", "***", "!?", "7", "it's"]
    texts = ["".join(r.choice(kind) for _ in range(r.randrange(40))) for kind in (odd, even) for _ in range(3000)]
    for text, ids in zip(texts, made.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgotten_words_are_learned_again(monkeypatch):
    from strandtally.llm import encode

    monkeypatch.setattr(encode, "MEMORY", 50)
    monkeypatch.setattr(encode, "CHARS", 300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    made, plain = Encoder(path, True), Tokenizer.from_file(path)
    texts = [rng_text(i, 40) for i in range(30)] * 2
    for text, ids in zip(texts, made.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_special_token_in_text(spark):
    """By the contract: the tokenizer's ids of the whole text, special tokens in it included."""
    docs = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "x <|ENDOFTEXT|> y")], "doc_id long, text string")
    rows = {r.doc_id: r.doc_tokens for r in packing.pack_documents(docs, packing.byte_bpe_path(), 1).collect()}
    assert rows == {1: 5, 2: len(plain_ids("x <|ENDOFTEXT|> y", Tokenizer.from_file(packing.byte_bpe_path())))}


def check_query(rows, tokenizer, source, capacity=2048):
    """Every piece against its own document's ids; pieces leave no gap in documents or sequences."""
    want = {r.doc_id: plain_ids(r.text, tokenizer) for r in source}
    assert set(rows.doc_id) == set(want)
    for doc, own in rows.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1].tolist()]
        assert own.length.sum() == len(want[doc]) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert zlib.crc32(want[doc][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()]
        assert s.length.sum() <= capacity


def test_query_against_brute_force(spark, tokenizer):
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op3_packing(spark, SF).toPandas()
    assert (rows.groupby("doc_id").size() > 1).any()
    check_query(rows, tokenizer, source)
