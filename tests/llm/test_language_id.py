import zlib

import numpy as np
import pytest

from strandtally.llm.language_id import UNKNOWN, held_out, identify, learn, op8_language_id, trigram_counts, trigram_vectors
from strandtally.llm.language_id import SYMBOLS, profile, symbol_table
from tests.conftest import SF


def predictions(docs, prototypes):
    return docs.select("doc_id", "text", identify(docs, prototypes).alias("q")).select("doc_id", "text", "q.*").collect()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs.select("*", held_out("doc_id", 3, 1).alias("held"))
    prototypes = learn(out.where("not held"))
    rows = out.where("held").select("lang", identify(docs, prototypes).alias("q")).collect()
    assert sum(r.lang == r.q.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.q.score <= 1 for r in rows)


def test_odd_rows(spark, nasty):
    prototypes = learn(nasty)
    assert set(prototypes) == {"en", "fr"}
    for r in predictions(nasty, prototypes):
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == UNKNOWN) == (not letters)
        assert 0 <= r.score <= 1


def test_nothing_to_learn_and_empty_table(spark, nasty, empty):
    assert learn(empty) == {}
    assert {r.lang_pred for r in predictions(nasty, {})} == {UNKNOWN}
    assert predictions(empty, learn(nasty)) == []


def test_too_many_languages(nasty):
    with pytest.raises(ValueError, match="more than 1"):
        learn(nasty, max_languages=1)


def test_profile_bundles_bound_letters():
    """A profile is the sum of the vectors of all trigrams, each the product of rolled letters."""
    which, counts = trigram_counts("Abc abc")
    table = symbol_table()
    symbols = [0, *(int(table[ord(c)]) for c in "abc abc"), 0]
    plain = [(a * SYMBOLS + b) * SYMBOLS + c for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False)]
    assert sorted(np.repeat(which, counts).tolist()) == sorted(plain)
    assert np.array_equal(profile("Abc abc"), trigram_vectors()[plain].astype(np.float32).sum(axis=0))


def test_ties_and_repeats(spark, nasty):
    prototypes = learn(nasty)
    prototypes = {"b": prototypes["en"], "a": prototypes["en"]}
    assert {r.lang_pred for r in predictions(nasty, prototypes)} == {"a", UNKNOWN}


def test_query_against_brute_force(spark):
    """The registered query, text by text: prototypes are sums of the profiles of the documents learned from."""
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in source}
    profiles = {r.doc_id: profile(r.text) for r in source}
    sums = {}
    for r in source:
        if not held[r.doc_id] and r.lang is not None and profiles[r.doc_id] is not None:
            sums[r.lang] = sums.get(r.lang, 0) + profiles[r.doc_id]
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    got = {r.doc_id: r for r in op8_language_id(spark, SF).collect()}
    assert set(got) == set(held)
    for i, v in profiles.items():
        assert got[i].held_out == held[i]
        if v is None:
            assert (got[i].lang_pred, got[i].score) == (UNKNOWN, 0.0)
            continue
        cosines = {k: float(u @ v / np.linalg.norm(v)) for k, u in unit.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].score == pytest.approx(max(0.0, cosines[best]), abs=1e-4)
        assert got[i].lang_pred == best or cosines[best] - cosines[got[i].lang_pred] < 1e-4
