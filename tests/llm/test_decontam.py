import random
import re

from strandtally.llm.decontam import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            if item is None:
                continue
            b = words(t)
            n = min(len(b), window)
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(40)] + ["É", "ß1"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 4, 9, 10, 11, 25, 40]))) for i in range(30)] + [(30, None), (31, "..."), (32, items_text := say(30)), (33, items_text), (None, say(12))]
    docs = []
    for i in range(60):
        parts = [say(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            b = words(r.choice(items)[1])
            a = r.randrange(0, max(1, len(b) - 8))
            parts += [" ".join(b[a : a + r.choice([8, 9, 10, 11, 20])]).upper(), say(r.randrange(0, 20))]
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, items_text * 50)]
    clash = lambda rows, name: spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], f"{name} long, text string, fp string, win string, n_hit string")
    got = decontaminate(clash(docs, "doc_id"), clash(items, "item_id")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in got) == sorted(brute(docs, items))


def test_odd_rows(spark, nasty, empty):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    got = decontaminate(nasty, bench).collect()
    assert len(got) == nasty.count()
    assert {x.doc_id for x in got if x.n_hit} == {13, 14}
    assert {x.n_hit for x in got} == {0, 11}
    assert {x.n_hit for x in decontaminate(nasty, bench.where("false")).collect()} == {0}
    assert decontaminate(empty, bench).count() == 0
