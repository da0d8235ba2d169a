"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandtally.llm import collocations as co
from tests.llm.conftest import rng_text


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    key = lang, tuple(words[i : i + m])
                    f[key] = f.get(key, 0) + 1
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in kept.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= 80 * f[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    out = []
    for lang in {k[0] for k in kept}:
        ranked = []
        for (of, p), a in kept.items():
            if of == lang and (of, p) not in gone:
                score, _, left, right = min((2_000_000 * a // (f[of, p[:k]] + f[of, p[k:]]), k, f[of, p[:k]], f[of, p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(n=60):
    r = random.Random(5)
    rows = []
    for i in range(n):
        text = rng_text(i, r.randrange(150), 40) + r.choice([" New York City is. big, YORK city", "\tnew  york\x0bcity", "; w1 w2 w3 w4 w5 w6", " é É ä", "\x00 \x00 nul"])
        rows.append((("en", None, "und", "fr")[i % 4], text.replace(" w7", ", w7")))
    return [*rows, (None, None), ("en", ""), ("xx", "alone"), ("en", rows[0][1]), ("en", "a b " * 300), ("de", " . ,, ! \n\n ")]


@pytest.mark.parametrize(("limit", "vocabulary", "pending"), [(co.LIMIT, co.VOCABULARY, co.PENDING), (50, 20, 10), (1, 10_000, 1)])
def test_brute_force(spark, monkeypatch, limit, vocabulary, pending):
    """Tries that are spilled all the time, or words that are numbered anew, change nothing."""
    for name, value in (("LIMIT", limit), ("VOCABULARY", vocabulary), ("PENDING", pending)):
        monkeypatch.setattr(co, name, value)
    rows = rows_of()
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, phrase int, words int, salt string").repartition(3)
    got = sorted(map(tuple, co.collocations(frame, least=4, top=30).collect()))
    assert got == brute(rows, 4, 30)
    assert len({r[0] for r in got}) > 2


@pytest.mark.parametrize("burst", [1, 5, 4096])
def test_trie(burst):
    """Any burst size gives the same counts, whole subtrees leave, and sizes add up."""
    r = np.random.default_rng(burst)
    trie, want = co.HatTrie(burst), Counter()
    for _ in range(5):
        first = r.integers(1, 5, 400)
        rest = (r.integers(1, 6, 400) << 42) | (r.integers(0, 4, 400) << 21) | r.integers(0, 3, 400)
        want.update(zip(first.tolist(), rest.tolist(), strict=True))
        trie.add(first, rest)
    assert trie.size == len(want) == sum(trie.sizes.values())
    if burst == 1:
        assert all(isinstance(node, dict) and not isinstance(node, Counter) for node in trie.root.values())
    got = Counter()
    for words in ([2], [1, 3, 4]):
        first, rest, counts = trie.take(words)
        assert set(first.tolist()) == set(words)
        got.update(dict(zip(zip(first.tolist(), rest.tolist(), strict=True), counts.tolist(), strict=True)))
    assert got == want
    assert trie.size == 0


def test_runs_are_sorted():
    own = co._Language()
    import pyarrow as pa

    own.number(pa.array(["b", "a", "c"]).dictionary_encode())
    run = own.run_of("en", np.array([1, 2, 1]), np.array([3 << 42, 1 << 42 | 3 << 21, 2 << 42]), np.array([5, 6, 7]))
    assert run.to_pydict() == {"lang": ["en"] * 3, "words": [3, 2, 2], "phrase": ["a b c", "b a", "b c"], "a": [6, 7, 5]}


def test_exact_products(spark):
    """Counts whose products pass 64 bits."""
    big = 9 * 10**17
    found = spark.createDataFrame([("en", 1, "x", 2 * big), ("en", 1, "y", big + 1), ("en", 2, "x y", big)], "lang string, words int, phrase string, a long")
    row = co.score_phrases(found).first()
    assert (row.l, row.r, row.score) == (2 * big, big + 1, 2_000_000 * big // (3 * big + 1))


def test_filters_let_all_frequent_pass(spark, monkeypatch):
    """A bitmap that is nearly full only lets more through."""
    monkeypatch.setattr(co, "FILTER_BITS", (6, 6))
    rows = rows_of(20)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, co.collocations(frame, least=3, top=50).collect())) == brute(rows, 3, 50)


def test_odd_tables(spark, nasty, empty):
    got = co.collocations(nasty, least=2, top=2000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([(r.lang, r.text) for r in nasty.select("lang", "text").collect()], 2, 2000)
    assert co.collocations(empty).collect() == []
