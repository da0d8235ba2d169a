"""Alignment of two tokenizers' ids over a corpus, by inverted bitmaps of id pairs.

Each text, with a space before it, is encoded by a byte-level BPE model (A) and a SentencePiece model
(B). Byte offsets where tokens of both end cut it into groups; an A and a B token whose byte ranges
overlap are linked.

Both models cut before a single space or line feed between two visible characters, and no group or link
reaches over such a cut. So texts are taken apart there, and each worker remembers ids, groups and links of
up to ``MEMORY`` distinct segments; new ones are encoded many at a time and aligned by numpy.

Documents are numbered within blocks of at most ``BLOCK_DOCS``. A block writes one posting for each pair of ids that it
holds: the documents with that pair as a compressed bitmap (a list of 16-bit numbers, or bits where those are
fewer bytes), and how often each has it in planes: plane k has, for each of these documents in turn, bit k of its
number of links. Blocks share no documents, so the OR of a pair's bitmaps has as many bits as they have together; only these
numbers are shuffled and added up. The postings then meet their pair's count, and give each document of the bitmap
the score times its links.

Cases: null and empty texts, and texts whose tokens of either model do not join to the same bytes, have zeros and an
empty hash; rows of equal id, or none, are documents each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.llm.textscan import give_back, pieces, take_turn
from strandtally.shared import materialize

MEMORY = 500_000
BLOCK_DOCS = 1 << 16
#: A block ends when it has so many (pair, document) entries.
BLOCK_ENTRIES = 3_000_000
CHARS = 4 << 20
_TOGETHER = 512
_CUT = re.compile(r"(?<=[\w!-~])(?=[ \n][\w!-~])")
_MARK = "\x1f"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE's letters: printable bytes stand for themselves, all others for U+0100 and up, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def marked(text: str) -> str:
    """``text`` with a space before it, and marks between segments that both models encode one by one."""
    whole = " " + text
    simple = "  " not in whole and " \n" not in whole and "\n " not in whole and "\n\n" not in whole and whole[-1] not in " \n" and whole.replace("\n", "").isprintable()
    return whole.replace("\n", _MARK + "\n").replace(" ", _MARK + " ")[1:] if simple else _MARK.join(_CUT.split(whole))


def segments(texts: list[str]) -> pa.ListArray:
    """The segments of each text; a text that holds the mark itself is one segment."""
    odd = [i for i, t in enumerate(texts) if _MARK in t]
    parts = pc.split_pattern(pa.array(["" if _MARK in t else marked(t) for t in texts], pa.large_string()), _MARK)
    if not odd:
        return parts
    parts = parts.to_pylist()
    for i in odd:
        parts[i] = [" " + texts[i]]
    return pa.array(parts, pa.list_(pa.large_string()))


class Aligner:
    """Ids, groups and links of segments, remembered."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=b_path)
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in named]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Let go of all segments but those that came first, which are the frequent ones."""
        if not keep:
            self.index: dict[str, int] = {}
            self.groups: list[str] = []
            self._counts: list[np.ndarray] = []  #: rows (A tokens, B tokens, groups, links, right) of segments
            self._pairs: list[np.ndarray] = []  #: A id << 32 | B id of each link
            return
        counts, pairs, _ = self.known()
        self.index = dict(itertools.islice(self.index.items(), keep))
        self.groups, self._counts = self.groups[:keep], [counts[:keep]]
        self._pairs = [pairs[: counts[:keep, 3].sum()]]

    def _both(self, text: str, lead: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by A and B without those of ``lead``, which is a space or begins with one; None if they do not join to it."""
        whole = lead + text
        a, b = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole[1:])
        data, n = whole.encode(), len(lead.encode()) if lead != " " else 0
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if not n:
            return a, b
        i, j = np.searchsorted(np.cumsum(self.a_size[a]), n), np.searchsorted(np.cumsum(self.b_size[b]), n)
        return a[i + 1 :], b[j + 1 :]

    def _align(self, texts: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Remember segments that have these ids together; False if they are not cut there by both."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.cumsum([len(t.encode()) for t in texts])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        at = np.searchsorted(both, ends)
        if len(both) != (at[-1] + 1) or (both[at] != ends).any():
            return False
        strings = lambda ids, end: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(end, both) + 1]), pa.int32()), pa.array(ids).cast(pa.string())), ",")
        groups = pc.binary_join_element_wise(strings(a, a_end), strings(b, b_end), "|")
        per = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at + 1]), pa.int32()), groups)
        # every stretch between two neighbouring ends lies in one token of each, and is what these two share
        link = np.union1d(a_end, b_end)
        pairs = a[np.searchsorted(a_end, link)] << 32 | b[np.searchsorted(b_end, link)]
        upto = [np.searchsorted(x, ends) + 1 for x in (a_end, b_end, both, link)]
        counts = np.stack([np.diff(x, prepend=0) for x in upto] + [np.ones(len(texts), np.int64)], axis=1)
        self._add(texts, counts, pc.binary_join(per, ";").to_pylist(), pairs)
        return True

    def _add(self, texts: list[str], counts: np.ndarray, groups: list[str], pairs: np.ndarray) -> None:
        self.index.update(zip(texts, range(len(self.groups), len(self.groups) + len(texts)), strict=True))
        self.groups += groups
        self._counts.append(counts)
        self._pairs.append(pairs)

    def learn(self, texts: list[str]) -> None:
        """Remember new segments, together where nothing but a single space or line feed joins them."""
        together, single = [], []
        for t in texts:
            (together if t.rfind(" ") < 1 and len(t) > 1 and t[1:].isprintable() else single).append(t)
        for at in range(0, len(together), _TOGETHER):
            part = together[at : at + _TOGETHER]
            ids = self._both("".join(part), " a")
            if ids is None or not self._align(part, *ids):
                single += part
        for t in single:
            ids = self._both(t[1:], " ") if t[0] == " " else self._both(t, " a")
            if ids is None or not self._align([t], *ids):
                self._add([t], np.zeros((1, 5), np.int64), [""], np.zeros(0, np.int64))

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of all remembered segments, their pairs, and where each one's begin."""
        if len(self._counts) > 1:
            self._counts, self._pairs = [np.concatenate(self._counts)], [np.concatenate(self._pairs)]
        counts = self._counts[0] if self._counts else np.zeros((0, 5), np.int64)
        return counts, self._pairs[0] if self._pairs else np.zeros(0, np.int64), np.cumsum(counts[:, 3]) - counts[:, 3]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and group hash of each text (none may be empty); and per pair of ids in a text: text, pair, links."""
        if len(self.index) > MEMORY:
            self.forget(MEMORY // 2)
        parts = segments(texts)
        lengths = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn([s for s in names if s not in self.index])
        own = np.array([self.index[s] for s in names], np.int64)
        counts, pairs, begins = self.known()
        which, begin = coded.indices.to_numpy().astype(np.int64), np.cumsum(lengths) - lengths
        totals = np.add.reduceat(counts[own[which]], begin, axis=0)
        right = totals[:, 4] == lengths
        named = pa.array([self.groups[i] for i in own], pa.large_string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begin, len(which)), pa.int32()), named.take(coded.indices)), pa.scalar(";", pa.large_string()))
        hashes = [hashlib.sha256(s.as_buffer()).hexdigest() if ok else "" for s, ok in zip(joined, right.tolist(), strict=True)]
        totals[~right] = 0
        # distinct segments of each text, then the pairs of these
        key, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(names) + which, return_counts=True)
        text, segment = key // len(names), own[key % len(names)]
        keep = right[text]
        text, segment, times = text[keep], segment[keep], times[keep]
        n = counts[segment, 3]
        at = np.repeat(begins[segment] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return totals[:, :4], hashes, np.repeat(text, n), pairs[at], np.repeat(times, n)


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner; its memory lasts from task to task."""
    return Aligner(a_path, b_path)


def pack_docs(docs: np.ndarray, size: int) -> bytes:
    """Sorted document numbers below ``size`` as 16-bit numbers, or as bits if these are fewer bytes."""
    if 2 * len(docs) <= (size + 7) // 8:
        return docs.astype("<u2").tobytes()
    bits = np.zeros(size, np.uint8)
    bits[docs] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_docs(data: bytes, n: int) -> np.ndarray:
    if len(data) == 2 * n:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def pack_planes(links: np.ndarray) -> bytes:
    """Bit planes of the numbers of links, lowest first; nothing where all are 1."""
    if links.max() == 1:
        return b""
    return b"".join(np.packbits((links >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(int(links.max()).bit_length()))


def unpack_planes(data: bytes, n: int) -> np.ndarray:
    out = np.full(n, 0 if data else 1, np.int64)
    width = (n + 7) // 8
    for k in range(len(data) // width if data else 0):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, width, k * width), count=n, bitorder="little").astype(np.int64) << k
    return out


_DOC = ["block", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_POST = ["a", "b", "docs", "links", "bits", "planes"]
_POST_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


class _Block:
    """The documents at hand, and their postings."""

    def __init__(self, number: int):
        self.number, self.size, self.keys, self.times, self.held = number, 0, [], [], 0

    def add(self, n: int, slots: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> None:
        self.keys.append((pairs >> 32 << 15 | pairs & 0x7FFF) << 16 | slots)
        self.times.append(links)
        self.held += len(slots)
        self.size += n

    def postings(self, rows: int = 4096):
        """Columns (block, a, b, docs, links, bits, planes) of so many pairs at a time."""
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        keys, at = np.unique(keys, return_inverse=True)
        links = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
        pair, slot = keys >> 16, keys & 0xFFFF
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        ends = np.append(first[1:], len(pair))
        for i in range(0, len(first), rows):
            cuts = list(zip(first[i : i + rows].tolist(), ends[i : i + rows].tolist(), strict=True))
            ids = pair[first[i : i + rows]]
            columns = [ids >> 15, ids & 0x7FFF, np.array([b - a for a, b in cuts]), np.add.reduceat(links[: ends[min(i + rows, len(ends)) - 1]], first[i : i + rows]), [pack_docs(slot[a:b], self.size) for a, b in cuts], [pack_planes(links[a:b]) for a, b in cuts]]
            yield pa.array(np.full(len(cuts), self.number)), [pa.array(c, t) for c, t in zip(columns, _POST_TYPES, strict=True)]


def scan(docs: DataFrame, a_path: str, b_path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (block, slot, doc_id and what its own text gives), and postings (block, a, b, docs, links, bits, planes)."""
    doc_type = docs.schema[doc_col].dataType.simpleString()

    def run(batches):
        take_turn("align", aligner.cache_clear)
        if aligner(a_path, b_path).b.get_piece_size() > 1 << 15:
            raise ValueError("the second tokenizer has more than 32768 ids")
        task, count = TaskContext.get().partitionId(), 0
        block, id_type = _Block(task << 32), None

        def documents(ids: pa.Array, totals: np.ndarray, hashes: list[str]) -> pa.RecordBatch:
            own = [pa.array(np.full(len(ids), block.number)), pa.array(block.size + np.arange(len(ids))), ids, *[pa.array(totals[:, i]) for i in range(4)], pa.array(hashes, pa.string())]
            return pa.RecordBatch.from_arrays(own + [pa.nulls(len(ids), t) for t in _POST_TYPES], _DOC + _POST)

        def postings(done: _Block):
            if done.keys:
                types = [pa.int64(), id_type, *[pa.int64()] * 4, pa.string()]
                for number, columns in done.postings():
                    yield pa.RecordBatch.from_arrays([number, *[pa.nulls(len(number), t) for t in types], *columns], _DOC + _POST)

        for batch in batches:
            for part in pieces(batch):
                id_type = part.column(0).type
                texts = part.column(1).to_pylist()
                at = 0
                while at < len(texts):
                    to, chars = at, 0
                    while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHARS):
                        chars += len(texts[to] or "")
                        to += 1
                    if block.held and (block.size + to - at > BLOCK_DOCS or block.held > BLOCK_ENTRIES):
                        yield from postings(block)
                        count += 1
                        block = _Block(task << 32 | count)
                    some = [i for i in range(at, to) if texts[i]]
                    totals, hashes = np.zeros((to - at, 4), np.int64), [""] * (to - at)
                    entries = [np.zeros(0, np.int64)] * 3
                    if some:
                        got, found, *entries = aligner(a_path, b_path).align([texts[i] for i in some])
                        places = np.array(some) - at
                        totals[places] = got
                        for i, h in zip(places.tolist(), found, strict=True):
                            hashes[i] = h
                        entries[0] = places[entries[0]] + block.size
                    yield documents(part.column(0).slice(at, to - at), totals, hashes)
                    block.add(to - at, *entries)
                    at = to
        yield from postings(block)
        give_back()

    fields = f"block long, slot long, doc_id {doc_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, docs long, links long, bits binary, planes binary"
    return docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(a, b, documents, all_links) of each pair of ids that is linked anywhere."""
    return postings.groupBy("a", "b").agg(F.sum("docs").alias("documents"), F.sum("links").alias("all_links"))


def _return_scores(batches):
    """Of postings with their pair's score, sorted by block: (block, slot, n_best, count_sum)."""

    def flush(block, best, total):
        hit = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), block)), pa.array(hit), pa.array(best[hit]), pa.array(total[hit])], ["block", "slot", "n_best", "count_sum"])

    at, best, total = None, None, None
    for batch in batches:
        for part in pieces(batch, 4096):
            cols = part.to_pydict()
            for block, n, bits, planes, count, is_best in zip(*[cols[k] for k in ("block", "docs", "bits", "planes", "documents", "best")], strict=True):
                if block != at:
                    if at is not None:
                        yield flush(at, best, total)
                    at, best, total = block, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
                slots, links = unpack_docs(bits, n), unpack_planes(planes, n)
                total[slots] += links * count
                if is_best:
                    best[slots] += links
    if at is not None:
        yield flush(at, best, total)


def align(docs: DataFrame, a_path: str, b_path: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    scanned = materialize(scan(docs, a_path, b_path, doc_col, text_col), "align-postings")
    postings = scanned.where("a is not null").select("block", *_POST)
    counts = materialize(pair_counts(postings).select("a", "b", "documents"), "align-counts")
    top = counts.groupBy("a").agg(F.max("documents").alias("top"))
    scored = counts.join(top, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best"))
    # the scores grow with the corpus, so they are never broadcast
    met = postings.select("block", "a", "b", "docs", "bits", "planes").join(scored.hint("merge"), ["a", "b"]).drop("a", "b")
    given = met.repartition("block").sortWithinPartitions("block").mapInArrow(_return_scores, "block long, slot long, n_best long, count_sum long")
    own = scanned.where("a is null").select(*_DOC)
    zero = F.lit(0).cast("long")
    return own.join(given, ["block", "slot"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_token_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
