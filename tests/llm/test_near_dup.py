import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandtally.llm import near_dup
from tests.llm.conftest import rng_text
from tests.llm.test_simhash import groups


def edited(text, rate, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"new{seed}{i}" if rng.random() < rate else w for i, w in enumerate(text.split()))


def test_near_duplicates_at_a_similarity(spark):
    rows, family = [], {}
    for k in range(8):
        base = rng_text(100 + k, 300, vocabulary=10**6)
        for j in range(6):
            family[len(rows)] = k
            rows.append((len(rows), base if j < 2 else edited(base, 0.01, j)))
    for k in range(30):
        family[len(rows)] = 100 + k
        rows.append((len(rows), rng_text(500 + k, 300, vocabulary=10**6)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, f in family.items():
        first.setdefault(f, i)
    wrong = [i for i in got if got[i] != first[family[i]]]
    assert len(got) == len(rows)
    assert len(wrong) <= 1


def plain_sets(rows, shingle=5):
    words = {i: (t or "").lower().split() for i, t in rows}
    return {i: {tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set() for i, w in words.items()}


def plain_groups(rows):
    sets = plain_sets(rows)
    return groups([(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))], sets)


def spaced_edits(text, k, mark):
    """``k`` words changed, five apart at least: a similarity of (n - 5k) / (n + 5k) for n shingles."""
    words = text.split()
    for j in range(k):
        words[10 + j * ((len(words) - 20) // k)] = f"{mark}{j}"
    return " ".join(words)


def test_near_duplicates_just_above_and_below(spark):
    """Pairs at 0.79 to 0.82 and 0.8 itself are judged by their sets."""
    rows = []
    for k in range(30):
        base = rng_text(2000 + k, 300, vocabulary=10**6)
        rows += [(2 * k, base), (2 * k + 1, spaced_edits(base, 6 + k % 2, f"edit{k}x"))]
    for k in range(10):
        base = rng_text(3000 + k, 49, vocabulary=10**6)  # 45 shingles; five of them changed: 0.8
        rows += [(100 + 2 * k, base), (101 + 2 * k, spaced_edits(base, 1, "e"))]
    rows += [(200, "one two three four five six seven eight nine ten"), (201, "one two three four five six seven eight nine other")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert 15 < sum(want[i] != i for i, _ in rows) < 30
    assert got == want


@pytest.mark.parametrize(("minority", "tile"), [(512, 128), (512, 2), (1, 2)])
def test_crowded_keys_miss_no_pair(spark, monkeypatch, minority, tile):
    """Documents of six of ten passages each, so that all keys are crowded; each has a near-duplicate."""
    monkeypatch.setattr(near_dup, "MINORITY", minority)
    monkeypatch.setattr(near_dup, "TILE", tile)
    monkeypatch.setattr(near_dup, "CHUNK", 2 * tile)
    passages = [rng_text(4000 + k, 50, vocabulary=10**6) for k in range(10)]
    rows = []
    for k, chosen in enumerate(list(itertools.combinations(passages, 6))[::6]):
        text = " ".join(chosen)
        rows += [(2 * k, text), (2 * k + 1, spaced_edits(text, 5, f"e{k}x"))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert len(set(want.values())) == len(rows) // 2
    assert got == want


def test_short_texts_keep_their_word_order(spark):
    rows = [(0, "yes no"), (1, "no yes"), (2, "Yes  NO"), (3, "a b c d"), (4, "d c b a"), (5, "yes"), (6, ""), (7, None)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}


def test_near_duplicates_of_odd_rows(spark, nasty, empty):
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(nasty).collect()}
    assert len(got) == nasty.where("doc_id is not null").select("doc_id").distinct().count()
    assert got[12] == got[11] == 11
    assert {got[i] for i in range(5)} == {0}
    assert near_dup.near_duplicate_groups(empty).count() == 0


def true_links(sets, similarity=0.8):
    """All pairs of sets that are similar enough: rare members first, similar sets share one in their prefixes."""
    count = Counter(g for s in sets.values() for g in s)
    held, out = defaultdict(list), set()
    for i, s in sets.items():
        order = sorted(s, key=lambda g: (count[g], hash(g)))
        for g in order[: len(order) - math.ceil(similarity * len(order) - 1e-9) + 1]:
            held[g].append(i)
    for ids in held.values():
        for a, b in itertools.combinations(ids, 2):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


def test_recall_of_links_in_a_crowd(spark):
    """12,000 documents: thousands share a passage, a third of the others is one group of near copies; pairs from 0.8 on."""
    passage = rng_text(1, 40, vocabulary=10**6)
    texts = [f"{passage} {rng_text(10_000 + i, 25 + i % 20, 10**6)}" for i in range(4000)]
    centre = rng_text(2, 200, vocabulary=10**6)
    texts += [spaced_edits(centre, 1 + i % 3, f"c{i}x") for i in range(3000)]
    for i in range(1500):
        base = rng_text(30_000 + i, 120 + i % 100, vocabulary=10**6)
        texts += [base, spaced_edits(base, 1 + i % 3, f"p{i}x")]
    texts += [f"{t}  " for t in texts[:1000]] + [rng_text(60_000 + i, 60, 10**6) for i in range(1000)]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = plain_sets(rows)
    same = defaultdict(list)
    for i, s in sets.items():
        same[frozenset(s)].append(i)
    exact = [(ids[0], i) for ids in same.values() for i in ids[1:]]
    # of the large group's pairs those with its first thirty members
    links = true_links({ids[0]: sets[ids[0]] for ids in same.values() if not 4030 <= ids[0] < 7000})
    links |= {(a, b) for a in range(4000, 4030) for b in range(4030, 7000) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    want = groups([*exact, *links], sets)
    assert len(exact) == 1000
    assert all(got[a] == got[b] for a, b in exact)
    apart = [(a, b) for a, b in links if len(sets[a] & sets[b]) < len(sets[a] | sets[b])]
    assert sum(got[a] == got[b] for a, b in apart) >= 0.99 * len(apart) > 1000
    # of pairs that are alone, as no other text connects them
    alone = [(a, b) for a, b in apart if a >= 7000]
    assert sum(got[a] == got[b] for a, b in alone) >= 0.97 * len(alone) > 500
    # no document goes that is no group's second
    assert not [i for i in got if got[i] != i and want[i] == i]


def matrix_links(sets, similarity=0.8):
    """All pairs of sets that are similar enough, by one product of matrices."""
    number = {g: i for i, g in enumerate(set().union(*sets.values()))}
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets.values()):
        held[i, [number[g] for g in s]] = 1
    common, ids = held @ held.T, list(sets)
    size = held.sum(axis=1)
    u, v = np.nonzero(np.triu(common >= similarity * (size[:, None] + size - common) - 1e-6, 1))
    return {(ids[a], ids[b]) for a, b in zip(u.tolist(), v.tolist(), strict=True)}


def template_pages(n, pool):
    """Pages of one template with four sentences of a pool each: 0.7 to 0.79 alike; each tenth has a near copy."""
    rng = np.random.default_rng(n)
    template, sentences = rng_text(8, 160, 10**6), [rng_text(70_000 + i, 6, 10**6) for i in range(pool)]
    texts = [" ".join([template, *(sentences[j] for j in rng.choice(pool, 4, replace=False))]) for _ in range(n)]
    return texts + [spaced_edits(t, 1 + i % 3, f"t{i}x") for i, t in enumerate(texts[::10])]


def test_template_pages(spark, n=1000, pool=100):
    """No link of pages that share nearly all is lost, and none below the similarity is made."""
    rows = list(enumerate(template_pages(n, pool)))
    sets = plain_sets(rows)
    links = matrix_links(sets)
    want = groups(links, sets)
    below = [(a, b) for a, b in itertools.pairwise(range(0, n, 2)) if 0.68 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.8]
    assert len(below) > 200
    assert len(links) >= n // 10
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_prefix_keys_are_few(spark):
    """A class has fewer keys than a fifth of its shingles and one more, and they grow with the classes; similar sets share one."""
    made = {}
    for n in (300, 600):
        sets = plain_sets(list(enumerate(template_pages(n, n // 10))))
        number = {g: i for i, g in enumerate(sorted(set().union(*sets.values())))}
        frame = spark.createDataFrame([(i, [number[g] for g in x]) for i, x in sets.items()], "id long, grams array<long>")
        keys = defaultdict(set)
        leads = defaultdict(set)
        for r in near_dup.prefix_keys(frame.select("id"), frame, 0.8).collect():
            keys[r.id].add(r.key)
            if r.lead:
                leads[r.id].add(r.key)
        assert all(len(k) <= len(sets[i]) - math.ceil(0.8 * len(sets[i]) - 1e-9) + 1 for i, k in keys.items())
        smaller = lambda a, b: (a, b) if len(sets[a]) <= len(sets[b]) else (b, a)
        assert all(leads[x] & keys[y] for x, y in (smaller(a, b) for a, b in matrix_links(sets)))
        assert max(Counter(g for x in leads.values() for g in x).values()) < n / 2  # the template leads none
        made[n] = sum(map(len, keys.values()))
    assert made[600] < 2.5 * made[300]


def test_keys_with_the_same_classes_are_one(spark):
    keyed = spark.createDataFrame([(k, i) for k, ids in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1, 2)), (4, (5,)), (5, (2, 3))) for i in ids], "key long, id long")
    known = spark.createDataFrame([(i, 10, [0, 0, 0, 0]) for i in range(6)], "id long, n long, fp array<long>")
    assert sorted((r.key, r.id) for r in near_dup.met_under(keyed, known).collect()) == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (5, 2), (5, 3)]


def test_hot_keys_are_dealt_out(spark):
    """Joins and counts of a key that most rows have give the plain result, from tasks of like size."""
    from pyspark.sql import functions as F

    from strandtally.llm.components import SALTS, salted_join, with_group_count

    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("key"), "id")
    table = spark.createDataFrame([(7, "hot"), (10, "ten"), (10, "again"), (99_999, "none")], "key long, name string")
    joined = salted_join(rows, table, ["key"], "id")
    assert sorted(map(tuple, joined.groupBy("name").count().collect())) == [("again", 1), ("hot", 18_000), ("ten", 1)]
    parts = rows.where("key = 7").groupBy(F.pmod(F.xxhash64("id"), F.lit(SALTS))).count().collect()
    assert max(r["count"] for r in parts) < 2 * 18_000 / SALTS
    counted = with_group_count(rows, "key", "id", "n")
    assert counted.where("key = 7").agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (18_000, 18_000, 18_000)
    assert counted.where("key <> 7").agg(F.max("n")).first()[0] == 1


def test_pivots_find_the_centre(spark):
    """Copies of one text with many or few edits: the text itself is nearest to the pivots, whatever they are."""
    base = rng_text(5, 150, vocabulary=10**6)
    rows = [(i, spaced_edits(base, 1 + i % 6, f"e{i}x") if i != 77 else base) for i in range(200)]
    made = near_dup.summaries(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
    led = near_dup.with_pivots(made.selectExpr("0L AS key", "doc_id AS id", "n", "fp")).collect()
    assert {r.centre.id for r in led} <= {77, *(i for i in range(200) if i % 6 == 0)}
    assert {len(r.d) for r in led} == {near_dup.PIVOTS + 1}


def test_classes_that_cannot_link_leave(spark):
    """A class leaves if its own shingles alone keep it from 0.8, and stays at the bound."""
    rows = [(1, 9, 8), (2, 9, 8), (3, 10, 8), (4, 20, 8)]
    sets = spark.createDataFrame([(1, [*range(8), 100]), (2, [*range(8), 200]), (3, [*range(7), 301, 302, 303]), (4, [*range(8), *range(400, 412)])], "id long, grams array<long>")
    apart = spark.createDataFrame([(0, i, n, i, least) for i, n, least in rows], "key long, id long, n long, root long, least long")
    assert {r.id for r in near_dup.may_link(apart, sets, 0.8).collect()} == {1, 2}


def test_blocks_link_every_part(spark, monkeypatch):
    """Of a group, links of the minority with all other parts, in one block and in many."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 10**6, 100)
    sets = {i: sorted({*base[: 100 - i % 30].tolist(), *range(10**7 + 100 * i, 10**7 + 100 * i + i % 7)}) for i in range(80)}
    root = {i: 0 if i % 4 else i for i in sets}
    rows = [(5, i, len(x), [0, None], root[i], 80, bool(root[i]), sum(map(bool, root.values()))) for i, x in sets.items()]
    apart = spark.createDataFrame(rows, "key long, id long, n long, d array<int>, root long, size long, minor boolean, minority long")
    frame = spark.createDataFrame(list(sets.items()), "id long, grams array<long>")
    alike = lambda a, b: 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})
    want = groups([(a, b) for a in sets for b in sets if a < b and (root[a] == root[b] or alike(a, b))], sets)
    for tile, chunk in ((128, 512), (3, 7)):
        monkeypatch.setattr(near_dup, "TILE", tile)
        monkeypatch.setattr(near_dup, "CHUNK", chunk)
        links = [tuple(r) for r in near_dup.block_links(apart, frame, 0.8).collect()]
        assert all(alike(a, b) and root[a] != root[b] for a, b in links)
        assert groups(links + [(a, b) for a in sets for b in sets if a < b and root[a] == root[b]], sets) == want
