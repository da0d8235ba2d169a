import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandtally import shared
from strandtally.llm import backoff_lm
from strandtally.llm.backoff_lm import D, op7_backoff_lm, train_and_score
from strandtally.llm.language_id import held_out
from tests.conftest import SF
from tests.llm.conftest import rng_text


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\x0b", " ").translate({9: 32, 10: 32, 12: 32, 13: 32}).split(" ") if w] + ["</s>"]


def plain_model(texts, states, arcs):
    """Score by definition, word by word."""
    c, pairs, begins = Counter(), Counter(), 0
    for t in texts:
        w = tokens(t)
        c.update(w)
        begins += 1
        pairs.update(zip(["<s>", *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    state = {w for w in c if c[w] * states >= n} | {"<s>"}
    arc = {p: k for p, k in pairs.items() if p[0] in state and p[1] in state and k * arcs >= n}
    history = dict(c) | {"<s>": begins}
    left = dict.fromkeys(state, 1.0)
    for (u, _), k in arc.items():
        left[u] -= (k - D) / history[u]
    p1 = lambda w: (c[w] - D) / n if w in c else D * v / n

    def score(text):
        total, base, known, u = 0.0, 0.0, 0, "<s>"
        for w in tokens(text):
            p = (arc[u, w] - D) / history[u] + left[u] * p1(w) if (u, w) in arc else (left[u] if u in state else 1) * p1(w)
            total += math.log10(p)
            base += math.log10((c[w] + 1) / (n + v + 1))
            known += w in c
            u = w
        return len(tokens(text)), known, n, base, total

    def mass(u):
        return sum((arc[u, w] - D) / history[u] + left[u] * p1(w) if (u, w) in arc else (left[u] if u in state else 1) * p1(w) for w in c) + (left[u] if u in state else 1) * D * v / n

    return score, mass


@pytest.mark.parametrize("block_bytes", [backoff_lm.BLOCK_BYTES, 2000])
def test_against_the_definition(spark, nasty, monkeypatch, block_bytes):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", block_bytes)
    docs = nasty.select("doc_id", "text").union(spark.createDataFrame([(100 + i, rng_text(i, 200)) for i in range(30)], "doc_id long, text string"))
    train = ~held_out("doc_id", 7, 2)
    rows = docs.select("text", train.alias("t")).collect()
    score, mass = plain_model([r.text for r in rows if r.t], 50, 400)
    out = train_and_score(docs, train, states=50, arcs=400)
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out.collect())
    want = sorted((a, b, n, round(x, 6), round(y, 6)) for a, b, n, x, y in (score(r.text) for r in rows))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        assert g[3:] == pytest.approx(w[3:], abs=1e-4)
    assert any(not r.t for r in rows)
    for u in ("<s>", "w1", "w2", "no such word"):
        assert mass(u) == pytest.approx(1)


@pytest.mark.parametrize(("shard_tokens", "block_bytes"), [(20_000, backoff_lm.BLOCK_BYTES), (2_000, 100_000), (100, 4_000)])
def test_no_pair_is_dropped(spark, monkeypatch, shard_tokens, block_bytes):
    """A pair seen once is an arc with one shard or thousands, and with words just above and below what is dealt out."""
    monkeypatch.setattr(backoff_lm, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", block_bytes)
    texts = [rng_text(i, 3000, 3000) for i in range(80 if shard_tokens > 100 else 8)]
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, block string, word string, h string, c string").repartition(3)
    train = F.col("doc_id") % 10 != 0
    out = {r.doc_id: r for r in train_and_score(docs, train).collect()}
    training = [t for i, t in enumerate(texts) if i % 10]
    score, _ = plain_model(training, 10**9, 10**9)
    counts = Counter(w for t in training for w in tokens(t)).values()
    assert any(c > shard_tokens // 4 for c in counts) and any(shard_tokens // 8 < c <= shard_tokens // 4 for c in counts)
    for i, t in enumerate(texts):
        assert out[i].score == pytest.approx(score(t)[4], abs=1e-4)


def test_shards_are_even(spark, monkeypatch):
    """A word in most places does not fill one shard: its pairs are dealt out."""
    monkeypatch.setattr(backoff_lm, "SHARD_TOKENS", 4_000)
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 40_000)
    texts = [" the ".join(f"u{i}x{j}" for j in range(400)) for i in range(100)]
    rows = spark.createDataFrame([(True, t, i) for i, t in enumerate(texts)], "train boolean, text string, doc_id long")
    n, bits = backoff_lm.crowded_cells(rows)
    assert n == 100 * 800
    spread = backoff_lm.Spread(spark.sparkContext.broadcast((bits, None)))
    shards = n // 4_000 + 1
    sent = backoff_lm.slices(rows, spread, shards, f"{shared.shared_dir(spark)}/even")
    sizes = [r[1] for r in sent.groupBy("shard").agg(F.sum(F.length("p") / 8)).collect()]
    assert len(sizes) == shards
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_nul_is_part_of_words(spark):
    texts = ["\x00 nul \x00", "a\x00b a\x00b \x00", "nul\x00", None, "plain words nul"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in train_and_score(docs, F.col("doc_id") != 4).collect()}
    score, _ = plain_model(texts[:4], 10**9, 10**9)
    for i, t in enumerate(texts):
        want = score(t)
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == want[:3]
        assert (out[i].base_score, out[i].score) == (pytest.approx(want[3]), pytest.approx(want[4], abs=1e-4))
    assert out[0].n_tokens == 4


def test_query_against_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    train = [r.text for r in source if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    score, _ = plain_model(train, 10**12, 10**12)
    got = {r.doc_id: tuple(r)[1:] for r in op7_backoff_lm(spark, SF).collect()}
    assert len(got) == len(source)
    for r in source:
        n_tokens, known, n, base, total = score(r.text)
        held, *counts, base_score, own = got[r.doc_id]
        assert (held, *counts) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, n_tokens, known, n)
        assert (base_score, own) == (pytest.approx(base, rel=1e-9, abs=1e-6), pytest.approx(total, rel=1e-9, abs=1e-4))


def test_better_than_its_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = train_and_score(docs, ~held_out("doc_id", 7, 2)).where("not train").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_no_training_and_empty_table(spark, nasty, empty):
    rows = train_and_score(nasty, F.lit(False)).collect()
    assert len(rows) == nasty.count()
    assert {(r.n_known, r.train_tokens, r.score) for r in rows} == {(0, 0, 0.0)}
    assert train_and_score(empty, F.lit(True)).count() == 0
