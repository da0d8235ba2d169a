"""URL filters: wildcard rules as one bit-parallel automaton.

All patterns (``*`` any run of characters, ``?`` one character, the whole URL must match) are laid
side by side as bits of several 64-bit words. Shift-And with a self-loop at each ``*`` then steps
all patterns over one character in a few word operations, for all URLs of a batch at once.

The canonical URL has scheme and host in lower case, no fragment, and each byte beyond ASCII
percent-encoded. Cases: a null URL is empty; a pattern of ``*`` alone matches anything, an empty
pattern an empty URL only; equal rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Programs and archives, accounts and shops, sessions, endless calendars, advertisements, hosts of spam, and
#: links that carry where a visitor came from, which lead to a page that has an address without.
BLOCK_GLOBS = (
    "*://*/*.exe", "*://*/*.msi", "*://*/*.apk", "*://*/*.iso", "*://*/*.zip", "*://*/*.rar", "*://*/*.tar.gz",
    "*://*/cgi-bin/*", "*://*/wp-login.php*", "*://*/wp-admin/*", "*://*/login*", "*://*/signin*", "*://*/logout*", "*://*/register*",
    "*://*/cart*", "*://*/checkout*", "*://*/basket/*", "*?*phpsessid=*", "*?*jsessionid=*", "*;jsessionid=*", "*?*sid=????????????????*",
    "*://*/calendar/????/??/*", "*?*replytocom=*", "*://ads.*", "*://*.doubleclick.*", "*://*/ads/*", "*://*/banner?/*", "*://*/search?*q=*",
    "*://*cheap-pills.*", "*://*spam-farm.*", "*?*utm_source=*", "*?*utm_campaign=*", "*?ref=*", "*&ref=*",
)

#: (host, path, verdict): a rule holds for the host and all its subdomains, and paths that begin so.
PREFIX_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_HEAD = re.compile(r"[^/?#]*?://[^/?#]*")


def canonical(url: str | None) -> bytes:
    url = (url or "").partition("#")[0]
    head = _HEAD.match(url)
    if head:
        url = head[0].translate(_FOLD) + url[head.end() :]
    raw = url.encode("utf-8", "surrogatepass")
    return raw if raw.isascii() else b"".join(bytes([b]) if b < 128 else b"%%%02X" % b for b in raw)


class GlobAutomaton:
    """Patterns packed into words; bit i of a state says that the pattern up to its character i matches the URL so far."""

    def __init__(self, patterns: tuple[str, ...]):
        self.patterns = patterns
        bits = [p.replace("*", "") for p in patterns]
        self.words = max(1, -(-sum(map(len, bits)) // 64))
        empty = lambda: np.zeros(self.words, np.uint64)
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.first, self.floating, self.loops = empty(), empty(), empty()
        self.last = np.full(len(patterns), -1)
        at = 0
        for k, p in enumerate(patterns):
            begin = at
            for i, c in enumerate(p):
                if c == "*":
                    continue
                word, bit = at // 64, np.uint64(1 << at % 64)
                if c == "?":
                    self.accepts[:, word] |= bit
                else:
                    self.accepts[ord(c), word] |= bit
                if at == begin:
                    self.first[word] |= bit
                    if p[0] == "*":
                        self.floating[word] |= bit
                if p[i + 1 : i + 2] == "*":
                    self.loops[word] |= bit
                at += 1
            if at > begin:
                self.last[k] = at - 1

    def run(self, urls: list[bytes]) -> np.ndarray:
        """A row per URL, a column per pattern."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        data = np.frombuffer(b"".join(urls), np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        state = np.zeros((len(urls), self.words), np.uint64)
        not_first, one, top = ~self.first, np.uint64(1), np.uint64(63)
        for t in range(int(lengths.max(initial=0))):
            n = int(np.searchsorted(-sorted_lengths, -t, side="left"))  # the URLs longer than t
            d = state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved = (moved & not_first) | (self.first if t == 0 else self.floating)
            state[:n] = (moved & self.accepts[data[begins[:n] + t]]) | (d & self.loops)
        out = np.zeros((len(urls), len(self.patterns)), bool)
        for k, p in enumerate(self.patterns):
            i = self.last[k]
            out[order, k] = (state[:, i // 64] >> np.uint64(i % 64)) & one if i >= 0 else (True if p else sorted_lengths == 0)
        return out


def match_globs(pages: DataFrame, patterns: tuple[str, ...] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, canonical_url, matched): ``matched`` holds the numbers of the patterns that match."""
    for p in patterns:
        if not p.isascii():
            raise ValueError(f"a pattern must be ASCII: {p!r}")

    def run(batches):
        automaton = GlobAutomaton(patterns)
        for batch in batches:
            urls = [canonical(u) for u in batch.column(1).to_pylist()]
            hits = automaton.run(urls)
            matched = [np.flatnonzero(h).tolist() for h in hits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([u.decode() for u in urls], pa.string()), pa.array(matched, pa.list_(pa.int32()))], ["page_id", "url", "canonical_url", "matched"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, canonical_url string, matched array<int>")


def filter_urls(pages: DataFrame, patterns: tuple[str, ...] = BLOCK_GLOBS, rules: tuple[tuple[str, str, str], ...] = PREFIX_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest fitting prefix rule decides, else the automaton, which blocks what it matches."""
    part = lambda n: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    out = match_globs(pages, patterns, id_col, url_col).withColumn("host", F.translate(part(1), _UPPER, _LOWER)).withColumn("path", part(2))
    rule, verdict = None, None
    for host, path, says in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    default = F.when(F.size("matched") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (default if verdict is None else verdict.otherwise(default)).alias("verdict"))


def op5_url_globs(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rules = sorted(PREFIX_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules)
    globs = " or ".join(f"canonical glob '{g}'" for g in BLOCK_GLOBS)
    return f"""
with a as (select page_id, coalesce(url, '') as url, regexp_extract(coalesce(url, ''), '^[^/?#]*?://[^/?#]*') as head from pages),
b as (select page_id, translate(head, '{_UPPER}', '{_LOWER}') || split_part(substr(url, length(head) + 1), '#', 1) as canonical,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from a)
select page_id, host, path, case {rule} end as rule, case {verdict} when {globs} then 'block' else 'allow' end as verdict from b"""


SQL = _sql()
