"""Collocations: phrases of two to four words that occur more often than their parts would have it.

Words are counted first, then phrases of two, then those of three and four, each level only where the level before can
have enough of all parts: a bitmap of frequent words or pairs, of sixteen bits each and at most 2 ** 28 bits (32 MB),
tells that. It lets some pass that are not frequent and never drops one that is.

Each task counts phrases in a HAT-trie of the ids its words have there: below the first word lies a hash
container of what follows, and one that holds more than ``BURST`` phrases bursts into containers for each next word.
When all hold more than ``LIMIT``, the largest subtrees are spilled whole, as runs sorted by their words. Spark deals these out by
language and first three words, two would put what follows a very common pair into one task, and merges runs by adding up.

A phrase's parts are looked up in the table of frequent phrases, which has them all as no part is rarer than the
whole. What is common to very many phrases is looked up once for each of sixteen salts. The first phrases of a
language come from the first of each of sixteen parts of it.

Cases: null texts are empty, null languages ``und``; repeated rows and ids count each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.llm.bitmaps import FILTER_BITS, Bitmap, bitmap_of
from strandtally.llm.textscan import byte_map, give_back, mix, scan, take_turn
from strandtally.shared import materialize

BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2000
CONTAINED = 80  #: per cent of a phrase's occurrences that a longer one has if it takes its place
#: Phrases in a container before it bursts, and in a task's tries before subtrees are spilled.
BURST, LIMIT = 4096, 600_000
#: Phrases that are put into a trie together, and words that a task numbers before it begins anew.
PENDING, VOCABULARY = 1 << 18, 400_000
SALTS = 16
_ID = 21  #: bits of a word's id
_LOW = (1 << _ID) - 1
_WORDS = byte_map(BLANKS + STOPS)
_JOINED = byte_map(b" ")
_STOP = np.isin(np.arange(256), np.frombuffer(STOPS, np.uint8))


class HatTrie:
    """Counts of phrases: a first word's id, and the ids of up to three more packed in 63 bits, 0 for none."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, {}, 0
        self.sizes: dict[int, int] = {}  #: phrases below each first word

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        for word, part in _slices(first[order], rest[order]):
            node, grown = self._add(self.root.get(word), part, 2 * _ID)
            self.root[word] = node
            self.sizes[word] = self.sizes.get(word, 0) + grown
            self.size += grown

    def _add(self, node, keys: np.ndarray, shift: int):
        """The node with these keys counted, and how many phrases are new; a node is a Counter, or a dictionary of nodes by next word."""
        if node is None:
            node = Counter()
        if isinstance(node, Counter):
            before = len(node)
            node.update(keys.tolist())
            grown = len(node) - before
            return (self._burst(node, shift) if len(node) > self.burst and shift else node), grown
        word, left = keys >> shift, keys & ((1 << shift) - 1)
        order, total = np.argsort(word, kind="stable"), 0
        for w, part in _slices(word[order], left[order]):
            node[w], grown = self._add(node.get(w), part, shift - _ID)
            total += grown
        return node, total

    def _burst(self, full: Counter, shift: int) -> dict:
        out: dict[int, Counter] = {}
        cut = (1 << shift) - 1
        for key, n in full.items():
            child = out.get(key >> shift)
            if child is None:
                child = out[key >> shift] = Counter()
            child[key & cut] = n
        return out

    def _gather(self, node, head: int, shift: int, keys: list[int], counts: list[int]) -> None:
        if isinstance(node, Counter):
            keys += [head | k for k in node] if head else node
            counts += node.values()
            return
        for word, child in node.items():
            self._gather(child, head | word << shift, shift - _ID, keys, counts)

    def take(self, words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remove the subtrees of these first words: first word, rest and count of each phrase."""
        keys: list[int] = []
        counts: list[int] = []
        ends = []
        for w in words:
            self._gather(self.root.pop(w), 0, 2 * _ID, keys, counts)
            self.size -= self.sizes.pop(w)
            ends.append(len(keys))
        first = np.repeat(np.array(words, np.int64), np.diff(ends, prepend=0))
        return first, np.array(keys, np.int64), np.array(counts, np.int64)


def _slices(words: np.ndarray, values: np.ndarray):
    """Each distinct value of sorted ``words`` with its part of ``values``."""
    at = np.flatnonzero(np.diff(words, prepend=-1))
    for a, b, w in zip(at.tolist(), [*at[1:].tolist(), len(words)], words[at].tolist(), strict=True):
        yield w, values[a:b]


class _Language:
    """A task's words and phrases of one language."""

    def __init__(self):
        self.ids: dict[str, int] = {}  #: from 1
        self.words = np.zeros(1, np.int64)
        self.trie, self.pending, self.waiting = HatTrie(), [], 0

    def number(self, coded: pa.DictionaryArray) -> np.ndarray:
        own = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in coded.dictionary.to_pylist()], np.int64)
        return own[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)

    def settle(self) -> None:
        if self.waiting:
            self.trie.add(*(np.concatenate(x) for x in zip(*self.pending, strict=True)))
            self.pending, self.waiting = [], 0

    def run_of(self, lang: str, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """Phrases as a run in the order of their words."""
        names = pa.array(list(self.ids), pa.string())
        rank = np.empty(len(names) + 1, np.int64)
        rank[pc.sort_indices(names).to_numpy() + 1], rank[0] = np.arange(1, len(names) + 1), 0
        ids = np.stack([first, rest >> 2 * _ID, rest >> _ID & _LOW, rest & _LOW])
        order = np.lexsort(rank[ids][::-1])
        ids, counts = ids[:, order], counts[order]
        phrase = names.take(pa.array(ids[0] - 1))
        for row in ids[1:]:
            more = names.take(pa.array(row - 1, mask=row == 0))
            phrase = pc.if_else(pa.array(row > 0), pc.binary_join_element_wise(phrase, more, " ", null_handling="skip"), phrase)
        return _batch(lang, (ids > 0).sum(axis=0), phrase, counts)


def _batch(lang: str, words: np.ndarray, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), pa.array(words, pa.int32()), phrase, pa.array(counts, pa.int64())], ["lang", "words", "phrase", "a"])


def _seed(lang: str) -> np.uint64:
    return mix(np.array([int.from_bytes(lang.encode()[:64], "little") % (1 << 64) ^ len(lang)], np.uint64))[0]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b)


def bitmap(table: DataFrame, words: int) -> Bitmap:
    """The bitmap of all (lang, phrase) of so many words in a table."""
    rows = table.where(F.col("words") == words).select("lang", "phrase")

    def run(batches):
        for batch in batches:
            langs, phrases = batch.column(0), batch.column(1)
            for lang in langs.unique().to_pylist():
                for found in scan(phrases.filter(pc.equal(langs, lang)), _JOINED):
                    h = found.hash ^ _seed(lang)
                    h = h if words == 1 else pair_hash(h[::2], h[1::2])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return bitmap_of(rows.mapInArrow(run, "h long"), rows.count(), FILTER_BITS)


def _spelt(found, used: np.ndarray) -> pa.DictionaryArray:
    """The words that are used, by Arrow's dictionary."""
    sizes = found.end - found.start
    inside = np.repeat(found.start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    data = found.data[inside[np.repeat(used, sizes)]] if not used.all() else found.data[inside]
    offsets = np.concatenate([[0], np.cumsum(sizes[used])]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), int(used.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


def count_phrases(texts: DataFrame, level: int, likely: Bitmap | None = None) -> DataFrame:
    """Partial counts (lang, words, phrase, a) of words (level 1), pairs (2), or threes and fours (3) in texts (lang, text).

    ``likely`` has the frequent words for level 2, the frequent pairs for level 3. Level 1 also gives the number of all
    words of a language, under a null phrase.
    """

    def run(batches):
        take_turn("phrases")
        state: dict[str, _Language] = {}

        def spill(share: float):
            """The largest subtrees, until a share of LIMIT is left."""
            for own in state.values():
                own.settle()
            held = sum(own.trie.size for own in state.values())
            by_size = sorted(((n, lang, w) for lang, own in state.items() for w, n in own.trie.sizes.items()), reverse=True)
            chosen: dict[str, list[int]] = {}
            for n, lang, w in by_size:
                if held <= share * LIMIT:
                    break
                chosen.setdefault(lang, []).append(w)
                held -= n
            for lang, words in chosen.items():
                yield state[lang].run_of(lang, *state[lang].trie.take(words))

        def totals(own: _Language, lang: str):
            n = len(own.ids)
            if n:
                yield _batch(lang, np.ones(n, np.int64), pa.array(list(own.ids), pa.string()), own.words[1 : n + 1])
                yield _batch(lang, np.zeros(1, np.int64), pa.nulls(1, pa.string()), own.words.sum(keepdims=True))

        def begin_anew():
            """Forget all words, and give out what is counted by them."""
            if level == 1:
                for lang, own in state.items():
                    yield from totals(own, lang)
            else:
                yield from spill(-1)
            state.clear()

        for batch in batches:
            for lang in batch.column(0).unique().to_pylist():
                seed = _seed(lang)
                for found in scan(batch.column(1).filter(pc.equal(batch.column(0), lang)), _WORDS):
                    own = state.setdefault(lang, _Language())
                    n = len(found.start)
                    if level == 1:
                        ids = own.number(_spelt(found, np.ones(n, bool)))
                        size = len(own.ids) + 1
                        if size > len(own.words):
                            own.words = np.concatenate([own.words, np.zeros(2 * size - len(own.words), np.int64)])
                        own.words[:size] += np.bincount(ids, minlength=size)
                    elif n > 1:
                        stop = np.cumsum(_STOP[found.raw])[found.start] + found.text * (1 << 32)
                        near, h = stop[1:] == stop[:-1], found.hash ^ seed
                        ok = near & (likely(h[1:]) & likely(h[:-1]) if level == 2 else likely(pair_hash(h[:-1], h[1:])))
                        if level == 3:
                            ok = np.append(ok[1:] & ok[:-1], False)  # begins of three words
                        used, at = np.zeros(n + 3, bool), np.flatnonzero(ok)
                        for i in range(level):
                            used[at + i] = True
                        if len(at):
                            ids = np.zeros(n + 3, np.int64)
                            ids[:n][used[:n]] = own.number(_spelt(found, used[:n]))
                            rest = ids[at + 1] << 2 * _ID
                            if level == 3:
                                rest |= ids[at + 2] << _ID
                                four = np.append(ok, False)[at + 1]
                                own.pending.append((ids[at][four], (rest | ids[at + 3])[four]))
                            own.pending.append((ids[at], rest))
                            own.waiting += sum(len(p[0]) for p in own.pending[-2 if level == 3 else -1 :])
                    if sum(x.waiting for x in state.values()) > PENDING:
                        for x in state.values():
                            x.settle()
                    if sum(x.trie.size for x in state.values()) > LIMIT:
                        yield from spill(0.5)
                    if sum(len(x.ids) for x in state.values()) > VOCABULARY:
                        yield from begin_anew()
        yield from begin_anew()
        give_back()

    return texts.mapInArrow(run, "lang string, words int, phrase string, a long")


def merge_runs(partial: DataFrame, least: int) -> DataFrame:
    """Sums by phrase of at least ``least``, and numbers of all words; runs meet by language and first three words."""
    head = F.substring_index("phrase", " ", 3)
    fourth = F.when(F.col("words") == 4, F.substring_index("phrase", " ", -1))
    runs = partial.select("lang", head.alias("prefix"), fourth.alias("fourth"), "a").repartition("lang", "prefix")
    sums = runs.groupBy("lang", "prefix", "fourth").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.col("prefix").isNull())
    phrase = F.when(F.col("prefix").isNotNull(), F.concat_ws(" ", "prefix", "fourth"))
    return sums.select("lang", F.coalesce(F.size(F.split(phrase, " ")), F.lit(1)).alias("words"), phrase.alias("phrase"), "a")


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """(lang, words, phrase, a): all phrases of 1 to 4 words that occur ``least`` times or more; without a phrase, the number of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    one = materialize(merge_runs(count_phrases(texts, 1), least), "phrases-1")
    two = materialize(merge_runs(count_phrases(texts, 2, bitmap(one, 1)), least), "phrases-2")
    more = materialize(merge_runs(count_phrases(texts, 3, bitmap(two, 2)), least), "phrases-3")
    return one.unionByName(two).unionByName(more)


def _looked_up(rows: DataFrame, part: str, counts: DataFrame, name: str) -> DataFrame:
    """``rows`` (lang, salt, ...) with the count of what column ``part`` has; a part that many rows have is dealt out by salt."""
    wanted = rows.select("lang", part, "salt").distinct()
    known = counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(name))
    return rows.join(wanted.join(known, ["lang", part]), ["lang", part, "salt"])


def _exact(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(20,0)")


def score_phrases(found: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words or more, by their lowest-scoring cut."""
    phrases = found.where("words > 1").select("lang", "words", "phrase", "a", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    counts = found.where("words between 1 and 3")
    both = _looked_up(_looked_up(cuts, "left", counts, "l"), "right", counts, "r")
    # whole division of decimals; a quotient would be rounded
    score = F.expr("CAST((CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    best = both.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def replaced(found: DataFrame, share: int = CONTAINED) -> DataFrame:
    """(lang, phrase) of those that a longer phrase takes the place of: it has ``share`` per cent of their occurrences."""
    w = F.split("phrase", " ")
    within = lambda n, m: [F.array_join(F.slice(w, i + 1, m), " ") for i in range(n - m + 1)]
    inner = F.when(F.col("words") == 3, F.array(*within(3, 2))).otherwise(F.array(*within(4, 2), *within(4, 3)))
    longer = found.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = found.where("words between 2 and 3").select("lang", "phrase", "a")
    return own.join(longer, ["lang", "phrase"]).where(_exact("longer") * 100 >= _exact("a") * share).select("lang", "phrase")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    found = frequent_phrases(docs, lang_col, text_col, least)
    numbers = found.where("phrase is null").select("lang", F.col("a").alias("n"))
    found = found.where("phrase is not null")
    kept = score_phrases(found).join(replaced(found), ["lang", "phrase"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(numbers, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, (select unnest(range(1, {MOST_WORDS + 1})) as m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as a from g group by all),
s as (select lang, cast(sum(a) as bigint) as n from f where m = 1 group by lang),
c as (select * from f where m > 1 and a >= {MIN_COUNT}),
k as (select lang, m, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from c),
q as (select k.lang, k.m, k.phrase, k.a, k, x.a as l, y.a as r, cast((2000000::hugeint * k.a) // (x.a + y.a) as bigint) as score from k
  join f x on x.lang = k.lang and x.phrase = array_to_string(w[1:k], ' ') join f y on y.lang = k.lang and y.phrase = array_to_string(w[k + 1:], ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as o from q) where o = 1),
u as (select lang, a as longer, array_to_string(w[i:i + n - 1], ' ') as phrase from (select lang, a, w, n, unnest(range(1, m - n + 2)) as i from (select distinct lang, m, a, w from k where m > 2) z, (select unnest([2, 3]) as n) where n < m)),
x as (select b.lang, b.phrase from b join u on u.lang = b.lang and u.phrase = b.phrase group by b.lang, b.phrase, b.a having 100::hugeint * max(longer) >= {CONTAINED} * b.a),
o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join x on x.lang = b.lang and x.phrase = b.phrase where x.phrase is null)
select o.lang, rank, phrase, a, l, r, n, score from o join s using (lang) where rank <= {TOP}"""
