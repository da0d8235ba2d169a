"""Secrets in texts: patterns, and values in credential context by the cost of guessing them.

The patterns are the contract's: assignments, access keys and hexadecimal runs. Beside them, any value that is given to a
name of a credential is weighed as a password guesser would: its cheapest cut into words, dates, repeats, keyboard
walks and single characters that are tried out, found by dynamic programming. Costs are thousandths of a bit. A value that takes 10 ** 10 guesses
or more is a secret; placeholders, words and dates are cheaper. Values that a pattern's span covers are not given again.

Words and how common they are come from the corpus itself, outside such values, so a secret that is copied often does not become a
word. Distinct values are cut into all the pieces that could be a word; only words that a bitmap of at most 32 MB does not
rule out are counted, and joined with the pieces. What many values or documents share is looked up for each of sixteen salts.

Cases: null and empty texts have no spans; repeated rows and ids are scanned each; an empty table gives no rows; extra
columns are ignored; offsets are code points.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.llm.bitmaps import Bitmap, bitmap_of
from strandtally.llm.textscan import byte_map, give_back, pieces, scan, take_turn
from strandtally.shared import materialize

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = "pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|credentials?|auth"
#: A credential's name, a sign, and its value: quoted within a line, or up to white space or a closing mark.
CONTEXT = re.compile(rf"""(?ai)(?:{NAMES})["'\]]*\x20*(?::=|=>|[:=])\x20*(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s"'<>(){{}}\[\],;]+))""")
_MAY = {"context": f"(?i)(?:{NAMES})", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}"}
#: Shorter values are no secrets.
MIN_VALUE = 6
#: 10 ** 10 guesses.
STRONG = round(1000 * math.log2(10**10))
SALTS = 16

# Cost model, in thousandths of a bit.
KIND = 1000  #: which kind of piece comes next, if it is no single character
DIGIT, LETTER, SIGN, OTHER = (round(1000 * math.log2(n)) for n in (10, 26, 33, 128))
YEAR, DATE, SEPARATED = round(1000 * math.log2(200)), round(1000 * math.log2(365 * 200)), 2000
KEYS, TURN = round(1000 * math.log2(47)), round(1000 * math.log2(6))
WORD_CHARS, LONGEST_UNIT, SHORTEST_WALK = (3, 24), 8, 4

# What guessers try first, in this order.
COMMON = (
    "password 123456 123456789 12345678 12345 qwerty abc123 111111 123123 admin letmein welcome monkey dragon iloveyou sunshine princess "
    "football baseball master shadow superman batman trustno1 passw0rd secret changeme default root guest test login hello example sample "
    "placeholder xxxxxx redacted none null your user token key"
).split()
_COMMON = {w: round(1000 * math.log2(i + 1)) for i, w in enumerate(COMMON)}
# Letters that signs and digits stand for.
LEET = str.maketrans("@4301!$578", "aaeoiisstb")
# Rows of a keyboard, without and with shift.
ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
SHIFTED = ("~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?")
#: Half a key to the right with each row.
PLACE = {c: (2 * i + r, r) for rows in (ROWS, SHIFTED) for r, row in enumerate(rows) for i, c in enumerate(row) if c != " "}

_LETTERS = byte_map(bytes([*range(65), *range(91, 97), *range(123, 128)]))
_DAY, _MONTH, _FULL = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9][0-9]"
_SEP = "(?P<s>[-/._ ]?)"
_DATES = [re.compile(f"(?a){a}{_SEP}{b}(?P=s){c}") for a, b, c in ((_FULL, _MONTH, _DAY), (_DAY, _MONTH, _FULL), (_MONTH, _DAY, _FULL))]
_YEAR = re.compile(f"(?a){_FULL}")
_WORDLIKE = re.compile(r"[A-Za-z@4301!$578\x80-\U0010ffff]{3,}")


def fold(text: str) -> str:
    """A-Z in lower case."""
    return text if text.islower() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_form(text: str) -> str:
    """A piece as the word it may stand for."""
    return fold(text).translate(LEET)


def possible_words(value: str):
    """(begin, end) of all pieces that could be a word."""
    for run in _WORDLIKE.finditer(value):
        a, b = run.span()
        for i in range(a, b - WORD_CHARS[0] + 1):
            for j in range(i + WORD_CHARS[0], min(b, i + WORD_CHARS[1]) + 1):
                yield i, j


def _has_letter(piece: str) -> bool:
    return any(c.isascii() and c.isalpha() or c > "\x7f" for c in piece)


def wanted_words(value: str, at_once: int = 1 << 16):
    """The words that pieces of a value may stand for, some more than once; so many at a time."""
    some: set[str] = set()
    for i, j in possible_words(value):
        if _has_letter(value[i:j]):
            some.add(plain_form(value[i:j]))
            if len(some) == at_once:
                yield sorted(some)
                some = set()
    if some:
        yield sorted(some)


def case_cost(piece: str) -> int:
    """What it takes to guess which letters are upper case."""
    upper, lower = sum("A" <= c <= "Z" for c in piece), sum("a" <= c <= "z" for c in piece)
    if not upper:
        return 0
    if not lower or upper == 1 and "A" <= piece[0] <= "Z":
        return 1000
    return round(1000 * math.log2(sum(math.comb(upper + lower, i) for i in range(1, min(upper, lower) + 1))))


def character_cost(c: str) -> int:
    if "0" <= c <= "9":
        return DIGIT
    if c.isascii():
        return LETTER if c.isalpha() else SIGN
    return OTHER


def walks(value: str):
    """(begin, end, cost) of the longest runs of neighbouring keys."""
    at, turns, way = 0, 0, None
    for i in range(1, len(value) + 1):
        step = None
        if i < len(value) and value[i - 1] in PLACE and value[i] in PLACE:
            (x, y), (u, v) = PLACE[value[i - 1]], PLACE[value[i]]
            if (y == v and abs(u - x) == 2) or (abs(v - y) == 1 and abs(u - x) == 1):
                step = u - x, v - y
        if step is None:
            if i - at >= SHORTEST_WALK:
                yield at, i, KEYS + round(1000 * math.log2(i - at)) + TURN * turns
            at, turns, way = i, 0, None
        elif step != way:
            turns, way = turns + 1, step


def dates(value: str):
    """(begin, end, cost) of years and of dates in the usual orders, with one separator or none."""
    for i in range(len(value)):
        if "0" <= value[i] <= "9":
            if m := _YEAR.match(value, i):
                yield i, m.end(), YEAR
            for pattern in _DATES:
                if m := pattern.match(value, i):
                    yield i, m.end(), DATE + (SEPARATED if m["s"] else 0)


def repeats(value: str):
    """(begin, length of the unit, times) of units that are repeated at once, from where the repetition begins."""
    for u in range(1, LONGEST_UNIT + 1):
        i = 0
        while i + u < len(value):
            end = i
            while end + u < len(value) and value[end] == value[end + u]:
                end += 1
            times = (end - i) // u + 1
            if times > 1 and times * u >= 3:
                yield i, u, times
            i = end + 1 if end > i else i + 1


def guess_cost(value: str, words: dict[str, int], depth: int = 0) -> int:
    """Thousandths of a bit it takes to guess a value; ``words`` gives the cost of words in plain form."""
    ending: dict[int, list[tuple[int, int]]] = {}

    def piece(i: int, j: int, cost: int) -> None:
        ending.setdefault(j, []).append((i, cost + KIND))

    for i, j in possible_words(value):
        own = value[i:j]
        plain = plain_form(own)
        if plain in words and _has_letter(own):
            piece(i, j, words[plain] + case_cost(own) + (1000 if fold(own) != plain else 0))
    low = fold(value)
    for word, cost in _COMMON.items():
        i = low.find(word)
        while i >= 0:
            piece(i, i + len(word), cost + case_cost(value[i : i + len(word)]))
            i = low.find(word, i + 1)
    for i, j, cost in [*walks(value), *dates(value)]:
        piece(i, j, cost)
    if not depth:
        for i, u, times in repeats(value):
            piece(i, i + u * times, guess_cost(value[i : i + u], words, 1) + round(1000 * math.log2(times)))
    best = [0]
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + character_cost(value[j - 1]), *(best[i] + cost for i, cost in ending.get(j, ()))]))
    return best[-1]


def values_of(text: str):
    """(begin, end, value) of the values in credential context."""
    for m in CONTEXT.finditer(text):
        group = m.lastgroup
        if m.end(group) - m.start(group) >= MIN_VALUE:
            yield m.start(group), m.end(group), m[group]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(begin, number of the kind, end) of the patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _may(texts: pa.Array, *kinds: str) -> np.ndarray:
    """Which texts can have a match of these kinds; null ones cannot."""
    found = [pc.fill_null(pc.match_substring_regex(texts, _MAY[k]), False).to_numpy(zero_copy_only=False) for k in kinds]
    return np.logical_or.reduce(found)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def scan_texts(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, base, found): the patterns' spans of each row, and the values that they do not cover."""
    doc_type = docs.schema[doc_col].dataType.simpleString()

    def run(batches):
        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, 1024):
                texts = part.column(1)
                base: list[list] = [[] for _ in range(len(texts))]
                found: list[list] = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(_may(texts, *_MAY)).tolist():
                    text = texts[i].as_py()
                    spans = base_spans(text)
                    base[i] = [{"start": a, "kind": k, "end": b} for a, k, b in spans]
                    found[i] = [{"start": a, "end": b, "value": v} for a, b, v in values_of(text) if not any(s <= a and b <= e for s, _, e in spans)]
                yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(texts))), part.column(0), pa.array(base, _SPAN), pa.array(found, _FOUND)], ["uid", "doc_id", "base", "found"])
                uid += len(texts)
        give_back()

    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"uid long, doc_id {doc_type}, base array<struct<start: int, kind: int, end: int>>, found array<struct<start: int, end: int, value: string>>")


def word_counts(texts: DataFrame, wanted: Bitmap) -> DataFrame:
    """(h, c): counts of words outside values in credential context, of those that may be wanted; the number of all under null."""

    def run(batches):
        take_turn("secrets")
        parts, held, total = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for batch in batches:
            column = batch.column(0)
            blank = np.flatnonzero(_may(column, "context")).tolist()
            if blank:
                own = column.to_pylist()
                for i in blank:
                    for a, b, _ in values_of(own[i]):
                        own[i] = own[i][:a] + " " * (b - a) + own[i][b:]
                column = pa.array(own, pa.string())
            for words in scan(column, _LETTERS):
                total += len(words.start)
                h = words.hash
                parts.append(h[wanted(h)])
                held += len(parts[-1])
                if held > 1 << 20:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total])], ["h", "c"])
        give_back()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _pieces_of(values: DataFrame) -> DataFrame:
    """(key, word, h): every word that may be in a value."""

    def run(batches):
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in wanted_words(value.as_py()):
                    column = pa.array(words, pa.string())
                    for found in scan(column, _LETTERS):
                        # a word a row, as these have no separators
                        own = column.slice(found.first, found.n_texts)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.string()), own, pa.array(found.hash.view(np.int64))], ["key", "word", "h"])

    return values.mapInArrow(run, "key string, word string, h long")


def _looked_up(rows: DataFrame, table: DataFrame, column: str, salt_by: str) -> DataFrame:
    """Rows with what ``table`` has for their column; a value that many rows have is dealt out by salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    wanted = salted.select(column, "salt").distinct().join(table, column)
    return salted.join(wanted, [column, "salt"]).drop("salt")


def value_costs(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, cost) of distinct values (key, value); words are counted in ``texts``."""
    parts = materialize(_pieces_of(values), "secret-pieces")
    hashes = materialize(parts.select("h").distinct(), "secret-hashes")
    counted = materialize(word_counts(texts, bitmap_of(hashes, hashes.count())), "secret-words")
    total = counted.where("h is null").first()
    total = total.c if total else 0
    known = counted.where("h is not null")
    words = _looked_up(parts, known, "h", "key").groupBy("key").agg(F.collect_set(F.struct("word", "c")).alias("words"))

    def run(batches):
        for batch in batches:
            costs = []
            for value, words in zip(batch.column(1), batch.column(2), strict=True):
                known = {w["word"]: round(1000 * math.log2(max(total, w["c"]) / w["c"])) for w in words.as_py() or ()}
                costs.append(guess_cost(value.as_py(), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64())], ["key", "cost"])

    return values.join(words, "key", "left").select("key", "value", "words").mapInArrow(run, "key string, cost long")


def secrets(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", strong: int = STRONG) -> DataFrame:
    """doc_id, base, spans: the patterns' spans and all spans of every row, as arrays of (start, kind, end) in order."""
    scanned = materialize(scan_texts(docs, doc_col, text_col), "secret-spans")
    each = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.start", "f.end", "f.value", F.sha2("f.value", 256).alias("key"))
    values = materialize(each.groupBy("key").agg(F.first("value").alias("value")), "secret-values")
    costs = materialize(value_costs(values, docs.select(F.col(text_col).cast("string").alias("text"))), "secret-costs")
    guess = F.lit(KINDS.index("guess"))
    strong_ones = _looked_up(each.drop("value"), costs.where(F.col("cost") >= strong).select("key"), "key", "uid")
    added = strong_ones.groupBy("uid").agg(F.collect_list(F.struct("start", guess.alias("kind"), "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start: int, kind: int, end: int>>"))))
    return scanned.select("uid", "doc_id", "base").join(added, "uid", "left").select("doc_id", "base", spans.alias("spans"))


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    def joined(spans: str):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[number(i).alias(f"n_{KINDS[i]}") for i in range(3)], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
