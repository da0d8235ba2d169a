import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandtally.llm import token_files
from strandtally.llm.elias_fano import EliasFano
from tests.conftest import SF


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=1500), st.integers(0, 1500), st.integers(0, 1500))
def test_elias_fano_select(values, first, count):
    values = np.sort(np.array(values, np.int64))
    coded = EliasFano.load(EliasFano.encode(values).dump())
    first = min(first, len(values))
    assert coded.select(first, count).tolist() == values[first : first + count].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 100_000))
    assert len(EliasFano.encode(values).dump()) < 100_000 * 12 / 8


def test_round_trip(spark, nasty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = token_files.read_token_files(token_files.write_token_files(nasty, token_files.word_bpe_path(), 2)).toPandas().sort_values("start")
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()) for r in nasty.select("doc_id", "text").collect()))
    assert len(rows) == len(source)
    start = 0
    for r, (known, doc, _, text) in zip(rows.itertuples(), source, strict=True):
        ids = np.array([*tokenizer.encode(text.decode(), add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert (r.doc_id == doc) if known else r.doc_id != r.doc_id
        start += len(ids)


def test_query_against_brute_force(spark):
    tokenizer = Tokenizer.from_file(token_files.word_bpe_path())
    got = {r.doc_id: tuple(r)[1:] for r in token_files.op6_token_files(spark, SF).collect()}
    start, want = 0, {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_empty_table_and_strange_file(spark, empty, tmp_path):
    assert token_files.read_token_files(token_files.write_token_files(empty, token_files.word_bpe_path(), 2)).count() == 0
    (tmp_path / "x").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError, match="not a token file"):
        token_files.TokenFile(str(tmp_path / "x"))
