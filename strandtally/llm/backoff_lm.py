"""Language-model scores from a weighted backoff automaton.

Tokens are the words of the text (A-Z lower-cased) and one end. The unigram model has all words of
the training texts, discounted by D: ``P(w) = (c - D) / N``, and ``D * V / N`` for any word that is
not among them.

On top of it stands a bigram automaton. Every word of the training texts is a state, and so is the
begin of a text; every pair of tokens that follow each other there is an arc, whose weight is
``(c(u, w) - D) / c(u) + fail(u) * P(w)``. For any other word the failure arc of u leads to the root,
with weight ``fail(u)``, which is what the arcs' discounted counts leave. Probabilities after each
state sum to one. ``states`` and ``arcs`` keep only those that make up such a share of the corpus, for
callers that want a smaller model; without them nothing is dropped.

Counts of words and pairs grow with the corpus and are never collected. Each task cuts its texts into blocks of
BLOCK_BYTES, numbers a block's distinct words and pairs, writes the texts as these numbers to a file in the shared folder, and
sends words and pairs, packed, to shards: a word's pairs go to the shard of the word. Shards add up, and give each block the
counts of its own words and pairs back, in the order in which it sent them. Texts are read twice, once to
count cells of words, and never shuffled.

The pairs of a word that could crowd a shard are dealt out over all shards by pair. Which words do is told by a bitmap of
CELLS cells of 256 KB at most, whose cells have more tokens than a fourth of a shard; another word in such a cell is only dealt out
as well. How many arcs these words have is added up in a table, and looked up for each block under sixteen salts.

Words and pairs are known by 64-bit hashes. Cases: null text is the end alone; without training texts
every probability is one; rows of equal id are scored each; null ids are training texts; extra columns
are ignored; all characters but the six separators belong to words, U+0000 too.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandtally.files import create, open_file
from strandtally.llm.language_id import held_out
from strandtally.llm.textscan import SPACE_WORDS, give_back, mix, scan
from strandtally.shared import materialize, new_path

D = 0.75
BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 2_000_000
CELLS, CHUNKS = 1 << 21, 256
SALTS = 16
#: What stands for the end and the begin of a text among the word hashes.
END, BEGIN = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x0B0E0B0E0B0E0B0E)
_FLUSH = 1 << 20


def _tokens(column: pa.Array):
    """Per part of a column: first row, rows, token hashes with ends, and each row's token range."""
    for words in scan(column, SPACE_WORDS):
        bounds = words.bounds + np.arange(words.n_texts + 1)
        out = np.full(int(bounds[-1]), END, np.uint64)
        out[np.arange(len(words.start)) + words.text] = words.hash
        yield words.first, words.n_texts, out, bounds


def crowded_cells(rows: DataFrame) -> tuple[int, bytes]:
    """The number of training tokens, and a bitmap of the cells that have more than a fourth of a shard."""

    def run(batches):
        cells, parts, held = np.zeros(CELLS, np.int64), [], 0

        def settle():
            np.add(cells, np.bincount((np.concatenate(parts) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS), out=cells)

        for batch in batches:
            for _, _, tokens, _ in _tokens(batch.column(0)):
                parts.append(tokens)
                held += len(tokens)
                if held > _FLUSH:
                    settle()
                    parts, held = [], 0
        if parts:
            settle()
        if cells.any():
            split = np.split(cells, CHUNKS)
            used = [i for i, x in enumerate(split) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([_pack(split[i]) for i in used], pa.binary())], ["chunk", "counts"])

    def total(table: pa.Table) -> pa.Table:
        cells = np.zeros(CELLS // CHUNKS, np.int64)
        for counts in table["counts"]:
            cells += _unpack(counts.as_py(), len(cells))
        return pa.table({"chunk": table["chunk"][:1], "n": [int(cells.sum())], "bits": [np.packbits(cells > limit, bitorder="little").tobytes()]})

    limit = SHARD_TOKENS // 4
    # the counts of all tasks meet chunk by chunk; a row for each of CHUNKS reaches the driver
    sums = rows.where("train").select("text").mapInArrow(run, "chunk long, counts binary").groupBy("chunk").applyInArrow(total, "chunk long, n long, bits binary").collect()
    bits = np.zeros((CHUNKS, CELLS // CHUNKS // 8), np.uint8)
    for r in sums:
        bits[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return sum(r.n for r in sums), bits.tobytes()


def frequent(rows: DataFrame, share: int, n: int) -> np.ndarray:
    """The sorted words that make up one ``share``-th of the tokens each; there are at most so many."""

    def run(batches):
        for batch in batches:
            for _, _, tokens, _ in _tokens(batch.column(0)):
                h, c = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    sums = rows.where("train").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return np.sort(np.array([r.h for r in sums.where(F.col("c") * share >= n).select("h").collect()], np.int64).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else np.uint8).astype(np.int64)


class Spread:
    """Which words have their pairs dealt out over all shards; ``data`` is a broadcast of the bitmap, and of the states of a limited model."""

    def __init__(self, data):
        self.data = data

    def __call__(self, h: np.ndarray) -> np.ndarray:
        bits, states = self.data.value
        if states is not None:
            return (h == BEGIN) | _among(h, states)
        cell = (h & np.uint64(CELLS - 1)).astype(np.int64)
        return (h == BEGIN) | (np.frombuffer(bits, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1)

    def keep(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray | None:
        """Which pairs a limited model may have as arcs; None for all."""
        states = self.data.value[1]
        return None if states is None else ((before == BEGIN) | _among(before, states)) & _among(tokens, states)


class Tally:
    """The distinct words and pairs of a block in the order in which they are sent.

    ``h``, ``c``, ``run``: an entry for each word in its shard, and for each spread word in the shards
    of its pairs; its training count (in its own shard), and how many pairs follow. ``p``, ``k``: hash
    and training count of each pair, by entry. ``word``, ``pair``: the entry of each token's word and its pair, -1 for none; ``begin``:
    the entry of the begin of texts.
    """

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, train: np.ndarray, spread: Spread, shards: int):
        trained = np.repeat(train, np.diff(bounds))
        word, at = np.unique(np.concatenate([tokens, np.full(len(train), BEGIN)]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([trained, train]), minlength=len(word)).astype(np.int64)
        before = histories(tokens, bounds)
        pair, kept = pair_hash(before, tokens), spread.keep(before, tokens)
        which = np.arange(len(tokens)) if kept is None else np.flatnonzero(kept)
        pair, first, to = np.unique(pair[which], return_index=True, return_inverse=True)
        k, u = np.bincount(to, weights=trained[which], minlength=len(pair)).astype(np.int64), before[which][first]
        home = np.where(spread(u), pair, u) % np.uint64(shards)
        shard, h = np.concatenate([word % np.uint64(shards), home]), np.concatenate([word, u])
        order = np.lexsort((h, shard))
        new = np.ones(len(order), bool)
        new[1:] = (shard[order][1:] != shard[order][:-1]) | (h[order][1:] != h[order][:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        self.shard, self.h = shard[order][new].astype(np.int64), h[order][new]
        self.c, self.run = np.zeros(len(self.h), np.int64), np.bincount(entry[len(word) :], minlength=len(self.h))
        self.c[entry[: len(word)]] = count
        order = np.lexsort((pair, entry[len(word) :]))
        self.p, self.k = pair[order], k[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.word, self.pair = entry[at[: len(tokens)]], np.full(len(tokens), -1)
        self.pair[which] = place[to]
        self.begin = int(entry[at[len(tokens)]])

    def parts(self) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        """The shards, where each one's entries begin and end, and where the pairs of each entry begin."""
        shards, starts = np.unique(self.shard, return_index=True)
        return shards, starts, [*starts[1:].tolist(), len(self.h)], np.concatenate([[0], np.cumsum(self.run)])


def histories(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What stands before each token."""
    before = np.roll(tokens, 1)
    before[bounds[:-1]] = BEGIN
    return before


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u) + w)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of consecutive columns, and the token range of each text."""
    lengths = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([t for t, _ in parts]), np.concatenate([[0], np.cumsum(lengths)])


_SENT = "shard long, block long, texts string, h binary, c binary, run binary, p binary, k binary"


def slices(rows: DataFrame, spread: Spread, shards: int, folder: str) -> DataFrame:
    """What each block sends to each shard; ``texts`` says where its texts are: file, begin, bytes."""

    def run(batches):
        count, path, out, at = 0, f"{folder}/{uuid.uuid4().hex}", None, 0
        task = TaskContext.get().partitionId() << 32
        parts, trains, ids, held = [], [], [], 0

        def flush():
            nonlocal out, at
            tokens, bounds = _joined(parts)
            t = Tally(tokens, bounds, np.concatenate(trains), spread, shards)
            own, at_word, times = np.unique(tokens, return_inverse=True, return_counts=True)
            rank = np.argsort(-times, kind="stable")
            number = np.empty(len(rank), np.int64)
            number[rank] = np.arange(len(rank))
            # frequent words have small numbers, which pack better
            columns = {"train": np.concatenate(trains).tobytes(), "bounds": bounds.tobytes(), "words": own[rank].tobytes(), "tokens": _pack(number[at_word])}
            texts = pa.concat_arrays(ids)
            batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), *[pa.array([v], pa.binary()) for v in columns.values()]], ["doc_id", *columns])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            raw = sink.getvalue()
            if out is None:
                out = create(path)
            out.write(raw)
            where, at = f"{path} {at} {raw.size}", at + raw.size
            shard_ids, starts, ends, pairs = t.parts()
            sent = []
            for i, a, b in zip(shard_ids.tolist(), starts.tolist(), ends, strict=True):
                x, y = int(pairs[a]), int(pairs[b])
                sent.append((i, task | count, where, t.h[a:b].tobytes(), _pack(t.c[a:b]), _pack(t.run[a:b]), t.p[x:y].tobytes(), _pack(t.k[x:y])))
            types = [pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent, strict=True), types, strict=True)], [f.split()[0] for f in _SENT.split(", ")])

        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, n, tokens, bounds in _tokens(batch.column(1)):
                if parts and held + 8 * len(tokens) > BLOCK_BYTES:
                    yield flush()
                    parts, trains, ids, held, count = [], [], [], 0, count + 1
                parts.append((tokens, bounds))
                trains.append(train[first : first + n])
                ids.append(batch.column(2).slice(first, n))
                held += 8 * len(tokens)
        if parts:
            yield flush()
        if out is not None:
            out.close()
        give_back()

    return rows.select("train", "text", "doc_id").mapInArrow(run, _SENT)


_GIVEN = "block long, shard long, texts string, c binary, n binary, s binary, k binary, word long, followers long, followed long, v long"


def totals(sent: DataFrame, n: int, spread: Spread, shards: int, arcs: int | None) -> DataFrame:
    """The sums, in the order of what was sent.

    By entry: the word's count, and number and summed counts of its arcs (``n``, ``s``); by pair: the
    arc's count, 0 if it is none. Other rows have a block and a spread word that it holds, a spread word and the arcs of it that a
    shard has (``word``, ``followers``, ``followed``), or the number of a shard's training words (``v``).
    """

    def run(table: pa.Table) -> pa.Table:
        got = {k: table[k].to_pylist() for k in table.column_names}
        lengths = [len(x) // 8 for x in got["h"]]
        h = np.frombuffer(b"".join(got["h"]), np.uint64)
        c, follow = (np.concatenate([_unpack(x, m) for x, m in zip(got[k], lengths, strict=True)]) for k in ("c", "run"))
        sizes = [len(x) // 8 for x in got["p"]]
        p = np.frombuffer(b"".join(got["p"]), np.uint64)
        k = np.concatenate([_unpack(x, m) for x, m in zip(got["k"], sizes, strict=True)])
        word, at = np.unique(h, return_inverse=True)
        count = np.bincount(at, weights=c, minlength=len(word)).astype(np.int64)
        pair, first, to = np.unique(p, return_index=True, return_inverse=True)
        arc = np.bincount(to, weights=k, minlength=len(pair)).astype(np.int64)
        arc[arc * arcs < n if arcs else arc < 1] = 0
        u = np.repeat(at, follow)[first]
        followers = np.bincount(u[arc > 0], minlength=len(word))
        followed = np.bincount(u, weights=arc, minlength=len(word)).astype(np.int64)
        hot, shard = spread(word), got["shard"][0]
        own = hot & (word % np.uint64(shards) == np.uint64(shard))
        out, e, x = [], 0, 0
        for i, (m, size) in enumerate(zip(lengths, sizes, strict=True)):
            here = at[e : e + m]
            out.append((got["block"][i], shard, got["texts"][i], _pack(count[here]), _pack(followers[here]), _pack(followed[here]), _pack(arc[to[x : x + size]]), None, None, None, None))
            out += [(got["block"][i], *[None] * 6, int(w), None, None, None) for w in word[here[own[here]]].view(np.int64)]
            e, x = e + m, x + size
        out += [(*[None] * 7, int(word[i].astype(np.int64)), int(followers[i]), int(followed[i]), None) for i in np.flatnonzero(hot & (followers > 0))]
        out.append((*[None] * 10, int(np.count_nonzero(count[word != BEGIN]))))
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4, *[pa.int64()] * 4]
        names = [f.split()[0] for f in _GIVEN.split(", ")]
        return pa.table({name: pa.array(col, t) for name, col, t in zip(names, zip(*out, strict=True), types, strict=True)})

    return sent.groupBy("shard").applyInArrow(run, _GIVEN)


def _block_scores(given: pa.Table, spread: Spread, shards: int, n: int, v: int) -> pa.Table:
    """Scores of the texts of a block, from what the shards gave back for it."""
    rows = given.to_pylist()
    got = sorted((r for r in rows if r["texts"]), key=lambda r: r["shard"])
    path, begin, size = got[0]["texts"].rsplit(" ", 2)
    with open_file(path) as file:
        file.seek(int(begin))
        texts = pa.ipc.open_stream(file.read(int(size))).read_all()
    raw = {name: texts[name][0].as_py() for name in texts.column_names if name != "doc_id"}
    bounds, train = np.frombuffer(raw["bounds"], np.int64), np.frombuffer(raw["train"], bool)
    t = Tally(np.frombuffer(raw["words"], np.uint64)[_unpack(raw["tokens"], int(bounds[-1]))], bounds, train, spread, shards)
    ids, starts, ends, pairs = t.parts()
    if ids.tolist() != [r["shard"] for r in got]:
        raise ValueError("a block did not get back what it sent")
    each = lambda name, sizes: np.concatenate([_unpack(r[name], m) for r, m in zip(got, sizes, strict=True)])
    entries = [b - a for a, b in zip(starts.tolist(), ends, strict=True)]
    count, followers, followed = (each(k, entries) for k in ("c", "n", "s"))
    arcs = each("k", [int(pairs[b] - pairs[a]) for a, b in zip(starts.tolist(), ends, strict=True)])
    hot = np.flatnonzero(spread(t.h) & (t.h % np.uint64(shards) == t.shard.astype(np.uint64)))
    of = {r["word"]: (r["followers"], r["followed"]) for r in rows if r["word"] is not None}
    if of:
        sums = np.array([of.get(w, (0, 0)) for w in t.h[hot].view(np.int64).tolist()], np.int64)
        followers[hot], followed[hot] = sums[:, 0], sums[:, 1]
    history = np.roll(t.word, 1)
    history[bounds[:-1]] = t.begin
    arc = np.where(t.pair >= 0, np.append(arcs, 0)[t.pair], 0)
    own, some = count[t.word], np.maximum(count[history], 1)
    weight = np.where(own > 0, own - D, D * v) / n if n else np.ones(len(own))
    fail = np.maximum(1 - (followed[history] - D * followers[history]) / some, 1e-12)
    total = np.log10(np.where(arc > 0, (arc - D) / some, 0) + fail * weight)
    at = bounds[:-1]
    known, base = np.add.reduceat((own > 0).astype(np.int64), at), np.add.reduceat(np.log10((own + 1) / (n + v + 1)), at)
    docs = texts["doc_id"].combine_chunks().flatten()
    return pa.table({"doc_id": docs, "train": pa.array(train), "n_tokens": np.diff(bounds), "n_known": known, "train_tokens": np.full(len(docs), n), "base_score": base, "score": np.add.reduceat(total, at)})


def train_and_score(docs: DataFrame, train: Column, doc_col: str = "doc_id", text_col: str = "text", states: int | None = None, arcs: int | None = None) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    rows = docs.select(train.alias("train"), F.col(text_col).cast("string").alias("text"), F.col(doc_col).alias("doc_id"))
    n, bits = crowded_cells(rows)
    spread = Spread(spark.sparkContext.broadcast((bits, None if states is None else frequent(rows, states, n))))
    shards = n // SHARD_TOKENS + 1
    given = materialize(totals(slices(rows, spread, shards, new_path(spark, "lm-texts")), n, spread, shards, arcs), "lm-counts")
    v = given.agg(F.sum("v")).first()[0] or 0
    sums = given.where("block is null and word is not null").groupBy("word").agg(F.sum("followers").alias("followers"), F.sum("followed").alias("followed"))
    salt = F.pmod("block", F.lit(SALTS)).alias("salt")
    held = given.where("block is not null and word is not null").select("block", "word", salt)
    known = held.select("word", "salt").distinct().join(sums, "word")
    back = given.where("texts is not null").select("block", "shard", "texts", "c", "n", "s", "k")
    everything = back.unionByName(held.join(known, ["word", "salt"]).drop("salt"), allowMissingColumns=True)
    kind = docs.schema[doc_col].dataType.simpleString()
    out = f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return everything.groupBy("block").applyInArrow(lambda table: _block_scores(table, spread, shards, n, v), out)


def op7_backoff_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = train_and_score(docs, ~held_out("doc_id", 7, 2))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
