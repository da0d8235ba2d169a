import fnmatch
import random

import pytest

from strandtally.llm.url_filter import PREFIX_RULES, GlobAutomaton, canonical, filter_urls, match_globs, op5_url_globs


def test_automaton_against_plain_matching():
    r = random.Random(2)
    patterns = ["".join(r.choice("ab*?") for _ in range(r.randrange(0, 9))) for _ in range(60)] + ["*", "", "a" * 70 + "*b", "?" * 65]
    urls = ["".join(r.choice("ab") for _ in range(r.randrange(0, 12))) for _ in range(300)] + ["a" * 70 + "xxb", "b" * 65, ""]
    hits = GlobAutomaton(tuple(patterns)).run([u.encode() for u in urls])
    for i, u in enumerate(urls):
        assert hits[i].tolist() == [fnmatch.fnmatchcase(u, p) for p in patterns], u


def test_rules_and_default(spark):
    rows = [
        (1, "http://Sub.Example.ORG/es/x", "example.org/es/", "block"), (2, "https://example.org/en/12", "example.org/en/1", "block"), (3, "https://example.org/xx", "org/", "allow"), (4, "https://example.org", None, "allow"),
        (5, "ftp://notorg/x", None, "allow"), (6, "http://a.com/fr/setup.exe", "com/fr/", "allow"), (7, "http://a.com/de/", "com/de/", "block"), (8, "http://a.com/it/setup.exe", None, "block"),
        (9, None, None, "allow"), (10, "no scheme", None, "allow"), (11, "", None, "allow"), (12, "http://a.com/it/setup.exe#top", None, "block"), (None, "http://x.net/cgi-bin/a", None, "block"), (8, "http://a.com/it/setup.exe", None, "block"),
    ]
    frame = spark.createDataFrame([(*r[:2], "clash", "clash") for r in rows], "page_id long, url string, host string, matched string")
    got = filter_urls(frame).collect()
    assert sorted([(r.page_id or 0, r.rule or "", r.verdict) for r in got]) == sorted([(a or 0, c or "", d) for a, _, c, d in rows])
    assert {r.page_id: (r.host, r.path) for r in got}[1] == ("sub.example.org", "/es/x")
    assert {r.page_id: (r.host, r.path) for r in got}[10] == ("", "")


def test_long_url_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "http://a.net/" + "x" * 20000 + ".exe")], "page_id long, url string")
    assert filter_urls(frame).first().verdict == "block"
    assert filter_urls(frame.where("false")).count() == 0
    assert match_globs(frame, ("*",)).first().matched == [0]
    with pytest.raises(ValueError, match="ASCII"):
        match_globs(frame, ("é*",))


def test_canonical():
    assert canonical("HTTP://Ex.COM/A?B#c") == b"http://ex.com/A?B"
    assert canonical("http://ex.com/é") == b"http://ex.com/%C3%A9"
    assert canonical(None) == b""


def test_the_automaton_decides_on_real_pages(spark):
    rows = op5_url_globs(spark, "/root/testdata/sf0.01").where("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in rows} == {"allow", "block"}
    assert all(r["count"] > 20 for r in rows)


def test_rules_of_equal_length(spark):
    """Of rules that fit and are equally long, the first in the list holds."""
    frame = spark.createDataFrame([(1, "http://a.bb.net/cc")], "page_id long, url string")
    rules = (("net", "/cc", "block"), ("bb.net", "/", "allow"), ("b.net", "/c", "allow"))
    assert len({len(h + p) for h, p, _ in rules[1:]}) == 1 and PREFIX_RULES
    assert filter_urls(frame, rules=rules).first().rule == "bb.net/"
    assert filter_urls(frame, rules=(("bb.net", "/", "block"), ("a.bb.net", "", "allow"))).first().verdict == "allow"
    assert filter_urls(frame, rules=(("bb.net", "/", "block"), ("bb.net", "/", "allow"))).first().verdict == "block"
