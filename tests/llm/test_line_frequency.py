import re
from collections import defaultdict

from strandtally.llm.line_frequency import MIN_LEFT, op4_line_frequency, quality


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, max_docs, min_left=MIN_LEFT):
    norm = lambda x: " ".join(words(x)).lower()
    docs = defaultdict(int)
    for _, t, host in rows:
        for x in {norm(x) for x in (t or "").split("\n") if words(x)}:
            docs[host, x] += 1
    out = []
    for i, t, host in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        seen = defaultdict(list)
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])].append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(8)}
        removed = sum(len(words(x)) for x in lines if docs[host, norm(x)] > max_docs)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        figures = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), removed)
        out.append((i is not None, i or 0, *figures, failed, not failed and len(w) - removed >= min_left * len(w)))
    return sorted(out)


def test_against_brute_force(spark, nasty, empty):
    shared = "this very line stands in a lot of documents"
    rows = [(r.doc_id, r.text, r.source) for r in nasty.select("doc_id", "text", "source").collect()]
    for i in range(12):
        own = " ".join(f"own{i}x{j}" for j in range(25))
        rows += [(100 + i, f"{shared}\n{own} # | <b>\n{shared.upper()}", "h1"), (200 + i, f" {shared}  \n" * 3 + " ".join(f"w{j}" for j in range(i * 3)), None), (300 + i, f"{shared}\n{own}", f"h{i}")]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], "doc_id long, text string, source string, uid string, key string, removed_words string")
    got = quality(docs, max_docs=5).collect()
    have = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_words, r.base_failed, r.kept) for r in got)
    assert have == brute(rows, 5)
    assert quality(empty).count() == 0


def test_depleted_documents_go_and_others_stay(spark):
    line = " ".join(f"menu{j}" for j in range(30))
    own = " ".join(f"text{j}" for j in range(80))
    rows = [(i, f"{line}\n{own} {i}" if i % 2 else f"{line}\nend {i}", "h") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=10).collect()}
    assert kept == {i: bool(i % 2) for i in range(20)}


def test_the_method_decides_on_real_documents(spark):
    """Some documents that the base keeps are rejected, by their lines alone."""
    rows = op4_line_frequency(spark, "/root/testdata/sf0.01").where("not base_failed").groupBy("kept").count().collect()
    found = {r.kept: r["count"] for r in rows}
    assert 0 < found[False] < 0.05 * found[True]
