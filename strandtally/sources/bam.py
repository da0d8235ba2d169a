"""Alignment files: header, linear index, records, and a writer for folders of them."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.files import create, open_file
from strandtally.functions.codecs import WINDOW
from strandtally.shared import materialize
from strandtally.sources.bgzf import EOF_MARKER, FormatError, data_end, deflate, read_member

# Fixed limits.
MAX_HEADER = 64 << 20
MAX_INDEX = 1 << 30
#: So few spans are walked one by one; a step over all of them costs as much as that.
FEW_SPANS = 40
MAX_MEMBER = 65_280  #: inflated bytes that surely fit a member
_RECORD = np.dtype([("block_size", "<u4"), ("ref_id", "<i4"), ("pos", "<i4"), ("name_len", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref_id", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4"), ("name", "u1")])


@dataclass(frozen=True)
class Header:
    references: tuple[tuple[str, int], ...]
    first_record: int  #: virtual offset
    text_length: int


class _Head:
    """Bytes of the first members, as far as they are needed."""

    def __init__(self, file, path: str):
        self.file, self.path, self.data, self.starts = file, path, b"", []

    def take(self, at: int, n: int, what: str) -> bytes:
        while len(self.data) < at + n:
            member = read_member(self.file, self.path)
            if member is None:
                raise FormatError(f"{self.path}: the file ends before its header")
            if member.is_eof:
                raise FormatError(f"{self.path}: an end marker stands before the end of the header")
            self.starts.append((len(self.data), member.offset, len(member.raw)))
            self.data += member.inflate(self.path)
            if len(self.data) > MAX_HEADER and len(self.data) < at + n:
                raise FormatError(f"{self.path}: the header is larger than {MAX_HEADER} bytes")
        return self.data[at : at + n]

    def i32(self, at: int, what: str) -> int:
        n = struct.unpack("<i", self.take(at, 4, what))[0]
        if n < 0:
            raise FormatError(f"{self.path}: negative {what}")
        return n

    def offset(self, at: int) -> int:
        """Virtual offset of a position; the end of a member is the begin of the next."""
        for start, offset, _ in reversed(self.starts):
            if start <= at < len(self.data) or (start <= at and at < start + 65536 and at < len(self.data)):
                return offset << 16 | at - start
        start, offset, size = self.starts[-1]
        return (offset + size) << 16


def read_header(path: str) -> Header:
    with open_file(path) as file:
        head = _Head(file, path)
        if head.take(0, 4, "magic") != b"BAM\1":
            raise FormatError(f"{path}: not a BAM file")
        text = head.i32(4, "text length")
        count, at, references = head.i32(8 + text, "reference count"), 12 + text, []
        for _ in range(count):
            n = head.i32(at, "name length")
            name = head.take(at + 4, n, "name")
            if not n or name[-1]:
                raise FormatError(f"{path}: a reference name does not end in NUL")
            references.append((name[:-1].decode(), head.i32(at + 4 + n, "reference length")))
            at += 8 + n
        return Header(tuple(references), head.offset(at), text)


def read_index(path: str) -> tuple[int, np.ndarray]:
    """Number of references, and rows (ordinal, ref_id, window_start, virtual offset) of the entries that are not zero."""
    with open_file(path) as file:
        if file.size() > MAX_INDEX:
            raise FormatError(f"{path}: the index is larger than {MAX_INDEX} bytes")
        data = file.read()
    if data[:4] != b"BAI\1":
        raise FormatError(f"{path}: not a BAI file")
    at = 4

    def i32(what: str) -> int:
        nonlocal at
        if at + 4 > len(data):
            raise FormatError(f"{path}: truncated while reading {what}")
        n = struct.unpack_from("<i", data, at)[0]
        if n < 0:
            raise FormatError(f"{path}: negative {what}")
        at += 4
        return n

    def skip(n: int, what: str) -> int:
        nonlocal at
        if at + n > len(data):
            raise FormatError(f"{path}: truncated while reading {what}")
        at += n
        return at - n

    found = []
    references = i32("reference count")
    for ref in range(references):
        for _ in range(i32("bin count")):
            skip(4, "a bin")
            skip(16 * i32("chunk count"), "chunks")
        n = i32("interval count")
        if n * WINDOW > 1 << 32:
            raise FormatError(f"{path}: a window start does not fit 32 bits")
        values = np.frombuffer(data, "<u8", n, skip(8 * n, "intervals"))
        used = np.flatnonzero(values)
        found.append(np.stack([np.full(len(used), ref), used * WINDOW, values[used].astype(np.int64)], axis=1))
    if len(data) - at not in (0, 8):
        raise FormatError(f"{path}: {len(data) - at} bytes after the index")
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return references, np.concatenate([np.arange(len(rows))[:, None], rows], axis=1)


def _walk(data: memoryview, at: int, end: int) -> tuple[list[int], int]:
    """Offsets of the records of one span, and its status."""
    found = []
    while at < end:
        if at + 4 > end:
            return found, 1
        size = int.from_bytes(data[at : at + 4], "little")
        if size < 32:
            return found, 2
        if at + 4 + size > end:
            return found, 3
        found.append(at)
        at += 4 + size
    return found, 0


def record_offsets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of all records in spans of ``data``, each one's span, and each span's status.

    Spans advance together, one record a step, while there are many; the longest are walked
    one by one then. Status 1: fewer than four bytes are left;
    2: a record is shorter than its fixed fields; 3: a record extends past its span.
    """
    at, status = starts.copy(), np.zeros(len(starts), np.int64)
    live = np.flatnonzero(at < ends)
    found, spans = [], []
    while len(live) > FEW_SPANS:
        here = at[live]
        short = here + 4 > ends[live]
        status[live[short]] = 1
        live, here = live[~short], here[~short]
        size = data[here].astype(np.int64) | data[here + 1].astype(np.int64) << 8 | data[here + 2].astype(np.int64) << 16 | data[here + 3].astype(np.int64) << 24
        small, over = size < 32, here + 4 + size > ends[live]
        status[live[over]], status[live[small]] = 3, 2
        good = ~small & ~over
        live, here, size = live[good], here[good], size[good]
        found.append(here)
        spans.append(live)
        at[live] = here + 4 + size
        live = live[at[live] < ends[live]]
    for i in live.tolist():
        own, status[i] = _walk(memoryview(data), int(at[i]), int(ends[i]))
        found.append(np.array(own, np.int64))
        spans.append(np.full(len(own), i))
    offsets, spans = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, spans))
    order = np.argsort(offsets, kind="stable")
    return offsets[order], spans[order], status


#: Each field's place in a record, its size, and whether it has a sign.
LAYOUT = {"block_size": (0, 4, False), "ref_id": (4, 4, True), "pos": (8, 4, True), "mapq": (13, 1, False), "flag": (18, 2, False), "next_ref_id": (24, 4, True)}


def decode(data: np.ndarray, offsets: np.ndarray, names: Iterable[str] = LAYOUT) -> dict[str, np.ndarray]:
    """The named fields of the records at these offsets."""

    def field(at: int, size: int, signed: bool) -> np.ndarray:
        x = sum(data[offsets + at + i].astype(np.int64) << 8 * i for i in range(size))
        return np.where(x >= 1 << 31, x - (1 << 32), x) if signed else x

    return {n: field(*LAYOUT[n]) for n in names}


class _Windows:
    """First offset of each window of each reference, as records come in order; what an index needs."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.last, self.unplaced = None, 0

    def add(self, refs: np.ndarray, positions: np.ndarray, offsets: np.ndarray) -> None:
        self.unplaced += int((refs < 0).sum())
        at = np.flatnonzero(refs >= 0)
        key = (refs[at].astype(np.int64) << 32) + positions[at] // WINDOW
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        if len(key):
            if key[0] == self.last:
                new = new[1:]
            self.last = key[-1]
        self.parts.append(np.stack([key[new].astype(np.uint64), offsets[at[new]]]))

    def dump(self, count: int) -> bytes:
        keys, offsets = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((2, 0), np.uint64)
        refs, windows = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = [b"BAI\1", struct.pack("<i", count)]
        for ref in range(count):
            own = np.flatnonzero(refs == ref)
            linear = np.zeros(int(windows[own].max()) + 1 if len(own) else 0, np.uint64)
            linear[windows[own]] = offsets[own]
            out += [struct.pack("<ii", 0, len(linear)), linear.astype("<u8").tobytes()]
        return b"".join(out) + struct.pack("<Q", self.unplaced)


class BamWriter:
    """Writes one file member by member, as records come; holds one member and the index."""

    def __init__(self, path: str, references: int, member_bytes: int, record: np.dtype = _RECORD):
        self.path, self.references, self.member_bytes, self.size = path, references, member_bytes, record.itemsize
        self.out, self.at, self.buffer, self.windows = create(path), 0, bytearray(), _Windows()
        self.records = self.bytes = 0
        head = b"BAM\1" + struct.pack("<ii", 0, references)
        head += b"".join(struct.pack("<i", len(n := f"chr{i + 1}\0".encode())) + n + struct.pack("<i", 1 << 29) for i in range(references))
        for at in range(0, len(head), MAX_MEMBER):
            self._member(head[at : at + MAX_MEMBER])

    def _member(self, data: bytes) -> None:
        raw = deflate(bytes(data))
        self.out.write(raw)
        self.at += len(raw)

    def add(self, rows: np.ndarray) -> None:
        """Records in order, as an array of the writer's record type."""
        done = 0
        while done < len(rows):
            # the records that begin in the member at hand
            room = -(-(self.member_bytes - len(self.buffer)) // self.size)
            part = rows[done : done + room]
            begins = np.uint64(self.at << 16) | (len(self.buffer) + np.arange(len(part)) * self.size).astype(np.uint64)
            self.windows.add(part["ref_id"], part["pos"], begins)
            self.buffer += part.tobytes()
            done += len(part)
            if len(self.buffer) >= self.member_bytes:
                self._member(self.buffer[: self.member_bytes])
                del self.buffer[: self.member_bytes]
        self.records += len(rows)
        self.bytes += rows.nbytes

    def close(self) -> tuple[str, int, int]:
        if self.buffer:
            self._member(self.buffer)
        self.out.write(EOF_MARKER)
        self.out.close()
        with create(self.path + ".bai") as out:
            out.write(self.windows.dump(self.references))
        return self.path, self.records, self.bytes


def write_bam(records: DataFrame, folder: str, references: int, member_bytes: int = MAX_MEMBER, by_reference: bool = False, payload: int = 0) -> DataFrame:
    """Write records (flag, mapq, ref_id, next_ref_id, pos) as a folder of indexed files, one for each range of positions.

    Gives (path, records, bytes) of each file. With ``by_reference`` there is one file for each reference instead, named
    ``ref-<id>-...``, which one task writes: for few records. A task that runs again writes another file; readers take the paths from here.
    Each record has ``payload`` bytes of symbols more. A column ``block_size`` takes the place of the true size in what is
    written, for files that are broken on purpose.
    """
    record = np.dtype([*_RECORD.descr, ("payload", "u1", (payload,))]) if payload else _RECORD
    if not record.itemsize <= member_bytes <= MAX_MEMBER:
        raise ValueError(f"member_bytes must be between {record.itemsize} and {MAX_MEMBER}")
    given = "block_size" in records.columns

    def run(batches):
        writer, ref, made, symbols = None, None, [], np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            columns = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            rows = np.zeros(batch.num_rows, record)
            rows["block_size"], rows["name_len"] = columns["block_size"] if given else record.itemsize - 4, 1
            if payload:
                rows["payload"] = symbols.integers(0, 16, (len(rows), payload), np.uint8)
            for n in ("flag", "mapq", "ref_id", "next_ref_id", "pos"):
                rows[n] = columns[n]
            cuts = [0, *(np.flatnonzero(rows["ref_id"][1:] != rows["ref_id"][:-1]) + 1).tolist(), len(rows)] if by_reference else [0, len(rows)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and (writer is None or by_reference and rows["ref_id"][a] != ref):
                    if writer:
                        made.append(writer.close())
                    ref = int(rows["ref_id"][a])
                    name = f"ref-{ref}" if by_reference else f"{TaskContext.get().partitionId():06d}"
                    writer = BamWriter(f"{folder}/{name}-{uuid.uuid4().hex}.bam", references, member_bytes, record)
                if b > a:
                    writer.add(rows[a:b])
        if writer:
            made.append(writer.close())
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*made, strict=True)), strict=True)))

    columns = records.select("flag", "mapq", "ref_id", "next_ref_id", "pos", *(["block_size"] if given else []))
    dealt = columns.repartition("ref_id") if by_reference else columns.repartitionByRange("ref_id", "pos")
    # records without a place come last, as in any sorted file
    ordered = dealt.sortWithinPartitions(F.col("ref_id") < 0, "ref_id", "pos", "flag", "mapq", "next_ref_id")
    return materialize(ordered.mapInArrow(run, "path string, records long, bytes long"), "bam-files")
