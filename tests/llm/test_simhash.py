import numpy as np
import pytest
import xxhash

from strandtally.llm import simhash
from strandtally.llm.components import connected_components
from tests.conftest import SF


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_against_brute_force(spark, nasty):
    got = simhash.simhash_components(nasty).collect()
    assert len(got) == nasty.count()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in nasty.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in got), key=key) == sorted(rows, key=key)
    known = [(i, f) for i, f in rows if i is not None]
    links = [(a, b) for a, f in known for b, g in known if a != b and (f ^ g).bit_count() <= 2] + [(a, b) for a, _ in known for b, _ in known if a == b]
    want = groups(links, {i for i, _ in known})
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)


@pytest.mark.parametrize(("few", "crowd"), [(64, 48), (2, 48), (2, 3)])
def test_links_join_exactly_what_is_near(spark, monkeypatch, few, crowd):
    """Random clusters of fingerprints, in small keys, in cells, and in crowded cells."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6):
        for _ in range(25):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            fps.add(int(np.uint64(x).astype(np.int64)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(frame)).collect()}
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2
    want = groups([(a, b) for a in fps for b in fps if a < b and near(a, b)], fps)
    assert {f: roots.get(f, f) for f in fps} == want


def test_pivots_never_discard_a_link():
    p = [x % (1 << 64) for x in simhash.pivots()]
    assert len(set(p)) == simhash.PIVOTS
    rng = np.random.default_rng(1)
    for x in rng.integers(0, 1 << 63, 200):
        x = int(x)
        y = x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        assert max(abs((x ^ q).bit_count() - (y ^ q).bit_count()) for q in p) <= 2


def test_pivots_choose_the_pairs_of_a_dense_key(spark, monkeypatch):
    """2,000 fingerprints that agree on two blocks, a few of them linked: most pairs never meet, nearly all others are discarded before any XOR."""
    monkeypatch.setattr(simhash, "CROWD", 1 << 40)
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 1 << 32, 2000)]
    fps += [x ^ (1 << int(rng.integers(32))) ^ (1 << int(rng.integers(32))) for x in fps[:60]]
    classes = simhash.pivot_table(spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")).cache()
    n = classes.count()
    met, crowded = simhash.meetings(classes.selectExpr("0 AS k", "0L AS bits", "fp", "d"), 2)
    pairs = met.cache().count()
    left = met.where(simhash.near_pivots("d", "d2", 2)).select("fp", "fp2").collect()
    linked = {(a, b) for a in fps for b in fps[2000:] + fps[:60] if a != b and (a ^ b).bit_count() <= 2}
    assert crowded.count() == 0
    assert pairs < 0.15 * n * (n - 1) / 2
    assert len(left) < 0.01 * pairs
    assert {(r.fp, r.fp2) for r in left} >= {(a, b) for a, b in linked if a < b}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = groups([(a, b) for a, x in fps.items() for b, y in fps.items() if a < b and (x ^ y).bit_count() <= 2], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_chain_component(spark):
    """A long chain needs many rounds; all of it gets the smallest id."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)], "u long, v long")
    got = connected_components(edges).collect()
    assert {r.root for r in got} == {100}
    assert len(got) == 60


def test_empty_table(spark, empty):
    assert simhash.simhash_components(empty).count() == 0
