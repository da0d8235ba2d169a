"""Spark data sources: ``bam`` (batch and stream), ``bai``, ``bgzf`` and ``bam_header``.

``spark.read.format("bam").load(path)`` takes a file or a folder of files, each with its index
beside it (``.bam.bai``); the option ``paths``, a JSON list, takes several. The index's offsets are where records
begin, so they cut each file into spans. Files are cut into splits of ``maxCompressedBytes`` (default 16 MiB) by
size alone, so planning opens no file; each task takes the spans that begin in its split. Splits cover each record
exactly once. A span that inflates to more than ``maxUncompressedBytes`` (default 256 MiB) is an error, as are records that
break their span. A worker keeps the headers and indexes that it has read, up to ``INDEX_BYTES``.

Comparisons of integer columns with constants are taken over by the source (``register`` turns that on). Those of ``ref_id`` and
``pos`` choose spans by the index, as its files are sorted by place: only these are inflated, and a task stops where
its records lie beyond the positions asked for. All other predicates stay with Spark.

Options of ``bam``: ``mode=permissive`` adds a column ``status``, 0 for records; a span whose records break it gives one row with
the reason's number and nulls instead of its records. ``record=true`` adds a column with each record's bytes.
``metrics=FOLDER`` writes what each split took, by stage, for ``scan_metrics``.

``bgzf`` gives the members of files, in splits too where there is an index. With ``mode=prefix`` it gives those members of
each file's front that inflate to at most ``maxUncompressedBytes`` together, up to an end marker; a file whose first
member is larger, or without members, is an error. With ``mode=integrity`` all members are inflated, and those that fail are given with the
reason; where members can no longer be told apart, the scan goes on at the next offset of the index.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as api
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from strandtally.files import create, exists, list_files, open_ahead, open_file, size_of
from strandtally.functions.codecs import WINDOW
from strandtally.sources.bam import decode, read_header, read_index, record_offsets
from strandtally.sources.bgzf import FormatError, data_end, read_member

FIELDS = {"block_size": pa.int64(), "ref_id": pa.int32(), "pos": pa.int32(), "mapq": pa.int32(), "flag": pa.int32(), "next_ref_id": pa.int32()}
ALIGNMENTS = "path string, span_id long, record_offset long, block_size long, ref_id int, pos int, mapq int, flag int, next_ref_id int"
CHUNK_BYTES = 16 << 20  #: a batch is passed on when its spans reach this size
INDEX_BYTES = 64 << 20  #: headers and indexes that a worker keeps


@dataclass
class Range(InputPartition):
    """Consecutive spans of a file: their virtual offsets, and the number of the first."""

    path: str
    first: int
    anchors: tuple[int, ...]


@dataclass
class Metrics:
    """What one split took.

    A member in which spans of two splits lie is inflated by both and counted by both. Only the first and last members of a run
    of spans can be shared; ``edges`` tells them, so that sums over splits can count each once.
    """

    path: str
    begin: int
    index_reads: int = 0
    anchors: int = 0
    spans: int = 0
    records: int = 0
    members: int = 0
    compressed_bytes: int = 0
    inflated_bytes: int = 0
    index_s: float = 0.0
    frame_s: float = 0.0
    inflate_s: float = 0.0
    walk_s: float = 0.0
    decode_s: float = 0.0
    edges: list[dict[str, int]] = field(default_factory=list)

    def inflated(self, offset: int, compressed: int, inflated: int, runs: int) -> None:
        """Count a member of the run of spans that began when there were ``runs`` edges."""
        self.members += 1
        self.compressed_bytes += compressed
        self.inflated_bytes += inflated
        del self.edges[runs + 1 :]
        self.edges.append({"offset": offset, "compressed_bytes": compressed, "inflated_bytes": inflated})

    def timed(self, stage: str, work, *args):
        began = time.perf_counter()
        out = work(*args)
        setattr(self, f"{stage}_s", getattr(self, f"{stage}_s") + time.perf_counter() - began)
        return out

    def write(self, folder: str) -> None:
        """A split that runs again writes the same file."""
        with create(f"{folder}/{hashlib.sha1(self.path.encode()).hexdigest()}-{self.begin}.json") as out:
            out.write(json.dumps(vars(self)).encode())


STAGES = ("index", "frame", "inflate", "walk", "decode")
METRICS = "path string, begin long, index_reads long, anchors long, spans long, records long, members long, compressed_bytes long, inflated_bytes long, " + ", ".join(f"{s}_s double" for s in STAGES) + ", edges array<struct<offset: bigint, compressed_bytes: bigint, inflated_bytes: bigint>>"


def scan_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each split that a scan with ``metrics=folder`` has read."""
    return spark.read.schema(METRICS).json(folder)


def default_index(path: str) -> str:
    return path + ".bai"


@dataclass
class Index:
    """A file's spans and index entries."""

    anchors: np.ndarray  #: where spans begin, and the end of the data
    rows: np.ndarray  #: (ordinal, ref_id, window_start, virtual offset)

    @property
    def nbytes(self) -> int:
        return self.anchors.nbytes + self.rows.nbytes


_kept: OrderedDict[tuple, Index | np.ndarray] = OrderedDict()


def _keep(what: str, path: str, index: str, read):
    """What ``read`` gives for a file and its index, and whether it had to be called; this worker keeps what it used last."""
    key = what, path, index, size_of(path), size_of(index)
    fresh = key not in _kept
    if fresh:
        _kept[key] = read()
        while len(_kept) > 1 and sum(x.nbytes for x in _kept.values()) > INDEX_BYTES:
            _kept.popitem(last=False)
    _kept.move_to_end(key)
    return _kept[key], fresh


def index_of(path: str, index: str | None = None) -> tuple[Index, bool]:
    """A file's index, and whether it had to be read."""
    index = index or default_index(path)

    def read() -> Index:
        header = read_header(path)
        references, rows = read_index(index)
        if references != len(header.references):
            raise FormatError(f"{path}: the index has {references} references, the file {len(header.references)}")
        with open_file(path) as file:
            end = data_end(file) << 16
        if header.first_record >= end:
            raise FormatError(f"{path}: there are no records")
        inner = rows[:, 3]
        return Index(np.unique(np.concatenate([[header.first_record], inner[(inner > header.first_record) & (inner < end)], [end]])), rows)

    return _keep("spans", path, index, read)


def anchors(path: str, index: str | None = None) -> np.ndarray:
    """Where spans begin, and the end of the data: first record, the index's offsets between, end; each once."""
    return index_of(path, index)[0].anchors


@dataclass
class Split(InputPartition):
    """The spans of a file that begin at compressed offsets from ``begin`` to before ``end``."""

    path: str
    begin: int
    end: int


def splits(path: str, max_compressed: int) -> list[Split]:
    """A file's splits, from its size; without a file none can be made, so a missing one is an error here."""
    step = max(1, max_compressed)
    return [Split(path, at, at + step) for at in range(0, max(1, size_of(path)), step)]


class Predicates:
    """Comparisons of a record's integers with constants, all of which must hold."""

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    _NAMES = {api.EqualTo: "eq", api.GreaterThan: "gt", api.GreaterThanOrEqual: "ge", api.LessThan: "lt", api.LessThanOrEqual: "le", api.In: "in"}

    def take(self, predicate) -> bool:
        """Take a predicate over, if it is of this kind."""
        name = predicate.attribute[0] if len(getattr(predicate, "attribute", ())) == 1 else None
        if name not in FIELDS:
            return False
        if isinstance(predicate, api.IsNotNull):
            return True
        op = self._NAMES.get(type(predicate))
        values = list(predicate.value) if op == "in" else [getattr(predicate, "value", None)]
        if op is None or not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return False
        self.tests.append((name, op, values if op == "in" else values[0]))
        return True

    def mask(self, fields: dict[str, np.ndarray]) -> np.ndarray | None:
        """Which records pass; None for all."""
        out = None
        for name, op, value in self.tests:
            x = fields[name]
            one = {"eq": lambda: x == value, "gt": lambda: x > value, "ge": lambda: x >= value, "lt": lambda: x < value, "le": lambda: x <= value, "in": lambda: np.isin(x, value)}[op]()
            out = one if out is None else out & one
        return out

    def bounds(self, name: str) -> tuple[float, float]:
        """Least and greatest value that a column can have."""
        low, high = float("-inf"), float("inf")
        for n, op, v in self.tests:
            if n != name:
                continue
            least = {"eq": v, "ge": v, "gt": v + 1}.get(op) if op != "in" else min(v, default=high)
            most = {"eq": v, "le": v, "lt": v - 1}.get(op) if op != "in" else max(v, default=low)
            low, high = low if least is None else max(low, least), high if most is None else min(high, most)
        return low, high

    def offsets(self, index: Index) -> list[tuple[int, int]] | None:
        """Ranges of virtual offsets that hold all records which can pass; None for the whole file.

        Files are sorted by reference and position, records without a reference last. Records of a reference
        begin after the last entry of those before it, and those at a position not before the entry of its window.
        """
        low, high = self.bounds("ref_id")
        if low == float("-inf") and high == float("inf"):
            return None
        ref, start, packed = index.rows[:, 1], index.rows[:, 2], index.rows[:, 3]
        end = int(index.anchors[-1])
        named = [set(v if op == "in" else [v]) for n, op, v in self.tests if n == "ref_id" and op in ("eq", "in")]
        refs = sorted(set.intersection(*named)) if named else None
        ranges: list[tuple[int, int]] = []

        def between(a: float, b: float) -> tuple[int, int]:
            before, after = packed[ref < a], packed[ref > b]
            return int(before.max()) if len(before) else 0, int(after.min()) if len(after) else end

        for a, b in [(r, r) for r in refs if low <= r <= high] if refs is not None else [(max(low, 0), high)]:
            if b < max(a, 0):
                continue
            begin, stop = between(a, b)
            least = self.bounds("pos")[0]
            if a == b and least > 0:
                own = packed[(ref == a) & (start >= least // WINDOW * WINDOW)]
                if not len(own):
                    continue
                begin = max(begin, int(own.min()))
            ranges.append((begin, stop))
        if low <= -1 <= high and (refs is None or -1 in refs):
            ranges.append((int(packed.max()) if len(packed) else 0, end))
        return ranges

    def beyond(self, fields: dict[str, np.ndarray]) -> bool:
        """Whether the first of some records lies after all that can pass, in the order of the file."""
        ref, (low, high), most = int(fields["ref_id"][0]), self.bounds("ref_id"), self.bounds("pos")[1]
        if low < 0:
            return False  # records without a reference come last
        return ref < 0 or ref > high or (ref == high and int(fields["pos"][0]) > most)


def spans_of(split: Split, index: str | None = None, wanted: Predicates | None = None, metrics: Metrics | None = None) -> list[Range]:
    """The spans that begin in a split and can hold records that are wanted, in runs of consecutive ones."""
    began = time.perf_counter()
    found, read = index_of(split.path, index)
    at = found.anchors
    begins = at[:-1] >> 16
    a, b = np.searchsorted(begins, [split.begin, split.end])
    keep = np.zeros(len(at), bool)
    keep[a:b] = True
    ranges = wanted.offsets(found) if wanted else None
    if ranges is not None:
        near = np.zeros(len(at), bool)
        for low, high in ranges:
            near[max(0, np.searchsorted(at, low, side="right") - 1) : np.searchsorted(at, high)] = True
        keep &= near
    edges = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    if metrics:
        metrics.index_reads, metrics.anchors = int(read), len(at)
        metrics.index_s += time.perf_counter() - began
    return [Range(split.path, int(i), tuple(at[i : j + 1].tolist())) for i, j in zip(edges[::2], edges[1::2], strict=True)]


def inflate_spans(file, part: Range, max_uncompressed: int, chunk: int, metrics: Metrics):
    """(number of first span, data, span starts, span ends) of spans that hold ``chunk`` bytes together, or one larger span.

    The chunk grows to CHUNK_BYTES, from a single span where it is 0.
    """
    todo, nth, starts, first = part.anchors, 0, [], part.first
    # inflated members since the first span that has not been passed on, joined once it is
    held, size = [], 0
    runs = len(metrics.edges)
    file.seek(todo[0] >> 16)
    while True:
        at = file.tell()
        # offsets that lie in the member at this place, or are its very begin
        while nth < len(todo) and todo[nth] >> 16 == at and todo[nth] & 65535 == 0:
            starts.append(size)
            nth += 1
        if starts and (nth == len(todo) or starts[-1] > chunk):
            if len(starts) > 1:
                data, cut = b"".join(held), starts[-1]
                yield first, np.frombuffer(data, np.uint8, cut), np.array(starts[:-1]), np.array(starts[1:])
                first += len(starts) - 1
                chunk = min(CHUNK_BYTES, 4 * max(chunk, 1 << 14))
                held, size, starts = [data[cut:]], size - cut, [0]
        if nth == len(todo):
            return
        if todo[nth] >> 16 < at:
            raise FormatError(f"{part.path}: offset {todo[nth]} is not at a member's begin")
        member = metrics.timed("frame", read_member, file, part.path)
        if member is None or member.is_eof:
            raise FormatError(f"{part.path}: the data ends before offset {todo[nth]}")
        raw = metrics.timed("inflate", member.inflate, part.path)
        metrics.inflated(at, len(member.raw), len(raw), runs)
        skip = 0
        if not starts:
            skip = todo[nth] & 65535
            if skip > len(raw):
                raise FormatError(f"{part.path}: offset {todo[nth]} lies beyond its member")
        while nth < len(todo) and todo[nth] >> 16 == at:
            within = todo[nth] & 65535
            if within > len(raw):
                raise FormatError(f"{part.path}: an offset lies beyond the member at {at}")
            starts.append(size + within - skip)
            nth += 1
        held.append(raw[skip:])
        size += len(raw) - skip
        if size - starts[-1] > max_uncompressed:
            raise FormatError(f"{part.path}: a span exceeds the configured {max_uncompressed} bytes")


def read_range(part: Range, max_uncompressed: int, wanted: Predicates, metrics: Metrics, names: list[str], permissive: bool = False):
    """Batches of the records of ``part`` with the columns ``names``; only fields that these or predicates name are decoded."""
    bounded = wanted.bounds("ref_id")[1] != float("inf")
    needed = {*names, *(n for n, _, _ in wanted.tests), *(("ref_id", "pos") if bounded else ()), *(("block_size",) if "record" in names else ())} & set(FIELDS)
    with open_ahead(part.path) as file:
        for first, data, starts, ends in inflate_spans(file, part, max_uncompressed, 0 if bounded else CHUNK_BYTES, metrics):
            if (ends <= starts).any():
                raise FormatError(f"{part.path}: span {first + int(np.argmax(ends <= starts))} is empty")
            offsets, spans, status = metrics.timed("walk", record_offsets, data, starts, ends)
            metrics.spans += len(starts)
            bad = np.flatnonzero(status)
            if len(bad) and not permissive:
                what = {1: "has trailing bytes", 2: "has a record that is too short", 3: "has a record that extends past it"}[int(status[bad[0]])]
                raise FormatError(f"{part.path}: span {first + int(bad[0])} {what}")
            if len(bad):
                good = status[spans] == 0
                offsets, spans = offsets[good], spans[good]
            fields = metrics.timed("decode", decode, data, offsets, needed)
            metrics.records += len(offsets)
            last = bounded and len(offsets) > 0 and wanted.beyond(fields)
            keep = wanted.mask(fields)
            if keep is not None and not keep.all():
                offsets, spans, fields = offsets[keep], spans[keep], {k: v[keep] for k, v in fields.items()}
            yield _records(part.path, first, data, starts, offsets, spans, fields, names)
            if len(bad) and not wanted.tests:
                yield _broken(part.path, first + bad, status[bad], names)
            if last:
                return


def record_bytes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of records that follow each other in ``data``, gaps allowed, copied at once and without an object for each.

    ``pa.array`` never lets go of memoryviews in a list (pyarrow 23), nor so of what they show.
    """
    turns = np.zeros(len(data) + 1, np.int8)
    turns[begins] = 1
    turns[ends] -= 1
    inside = np.cumsum(turns[:-1], dtype=np.int8).view(bool)
    # a batch holds 2 GB of such bytes at most, and says so
    bounds = pa.array(np.concatenate([[0], np.cumsum(ends - begins)]), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, bounds.buffers()[1], pa.py_buffer(data[inside])])


def _records(path, first, data, starts, offsets, spans, fields, names) -> pa.RecordBatch:
    n = len(offsets)

    def column(name: str) -> pa.Array:
        if name in FIELDS:
            return pa.array(fields[name]).cast(FIELDS[name])
        if name == "path":
            return pa.array([path], pa.string()).take(pa.array(np.zeros(n, np.int32)))
        if name == "record":
            return record_bytes(data, offsets, offsets + 4 + fields["block_size"])
        return pa.array({"span_id": lambda: first + spans, "record_offset": lambda: offsets - starts[spans], "status": lambda: np.zeros(n, np.int32)}[name]())

    return pa.RecordBatch.from_arrays([column(x) for x in names], names)


def _broken(path: str, spans: np.ndarray, status: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each span that its records break."""
    known = {"path": pa.array([path] * len(spans), pa.string()), "span_id": pa.array(spans), "status": pa.array(status.astype(np.int32))}
    kinds = FIELDS | {"record_offset": pa.int64(), "record": pa.binary()}
    return pa.RecordBatch.from_arrays([known[x] if x in known else pa.nulls(len(spans), kinds[x]) for x in names], names)


def _files(options: dict, suffix: str) -> list[str]:
    named = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    return [f for p in named for f in list_files(p, suffix)]


def _switch(options: dict, name: str) -> bool:
    value = options.get(name, "false").lower()
    if value not in ("true", "false"):
        raise ValueError(f"{name} must be true or false")
    return value == "true"


def columns(options: dict) -> list[str]:
    """All columns that the ``bam`` source has under these options."""
    return [c.split()[0] for c in ALIGNMENTS.split(", ")] + (["status"] if options.get("mode") == "permissive" else []) + (["record"] if _switch(options, "record") else [])


def schema_of(*names: str) -> str:
    """A schema for ``spark.read.format("bam").schema(...)``: a scan then decodes and hands over these columns alone."""
    return ", ".join(f"{n} {_TYPES[n]}" for n in names)


_TYPES = dict(c.split() for c in (ALIGNMENTS + ", status int, record binary").split(", "))


def chosen(schema: StructType, names: list[str]) -> list[str]:
    """The columns of a schema that a user gave, at least one, each of which must be one of ``names`` with its type."""
    if not schema.fields:
        raise ValueError("a scan needs a column")
    for field in schema.fields:
        if field.name not in names:
            raise ValueError(f"there is no column {field.name}; there are {', '.join(names)}")
        if (kind := field.dataType.simpleString()) != (own := _TYPES[field.name].replace("long", "bigint")):
            raise ValueError(f"column {field.name} has the type {own}, not {kind}")
    return schema.names


class _Options:
    def __init__(self, options: dict):
        self.files = _files(options, ".bam")
        self.index = options.get("bai")
        self.compressed = int(options.get("maxcompressedbytes", 16 << 20))
        self.uncompressed = int(options.get("maxuncompressedbytes", 256 << 20))
        if not 0 < self.uncompressed < 1 << 32:
            raise ValueError("maxUncompressedBytes must be between 1 and 4294967295")
        self.permissive, self.metrics = options.get("mode") == "permissive", options.get("metrics")
        self.names = columns(options)
        self.wanted = Predicates()

    def choose(self, schema: StructType) -> _Options:
        """Give the columns of ``schema`` only."""
        self.names = chosen(schema, self.names)
        if self.permissive and "status" not in self.names:
            raise ValueError("mode=permissive needs the column status, which tells broken spans from records")
        return self

    def splits(self) -> list[Split]:
        return [s for f in self.files for s in splits(f, self.compressed)]

    def read(self, split: Split):
        metrics = Metrics(split.path, split.begin)
        for part in spans_of(split, self.index, self.wanted, metrics):
            yield from read_range(part, self.uncompressed, self.wanted, metrics, self.names, self.permissive)
        if self.metrics:
            metrics.write(self.metrics)


class BamReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = _Options(options).choose(schema)
        if options.get("mode", "failfast") not in ("failfast", "permissive"):
            raise ValueError(f"unknown mode {options['mode']!r}; there are failfast, permissive")

    def pushFilters(self, filters):
        for one in filters:
            if not self.options.wanted.take(one):
                yield one

    def partitions(self):
        return self.options.splits()

    def read(self, partition):
        yield from self.options.read(partition)


class BamStreamReader(DataSourceStreamReader):
    """A stream of splits. ``streaming=all`` offers all at once and suits any trigger; ``bounded`` offers one split a
    batch, and must run with the default trigger until the offset reaches the number of splits. Both read the files that are
    there when they start; ``files`` is ``FileStreamReader``."""

    def __init__(self, options: dict, schema: StructType):
        self.options = _Options(options).choose(schema)
        self.bounded = options.get("streaming", "all") == "bounded"
        self.planned = self.options.splits()
        self.at = 0

    def initialOffset(self):
        return {"split": 0}

    def latestOffset(self):
        self.at = min(len(self.planned), self.at + 1) if self.bounded else len(self.planned)
        return {"split": self.at}

    def partitions(self, start, end):
        return self.planned[start["split"] : end["split"]]

    def read(self, partition):
        yield from self.options.read(partition)


class FileStreamReader(DataSourceStreamReader):
    """A stream of the splits of files that appear in folders, in the order in which they are found.

    Found files are logged in the folder ``fileLog`` with their sizes, so a split's number never changes, and a query that goes on
    from its checkpoint reads none twice. A file counts once its index is there; files must not change after that. At most
    ``maxSplitsPerTrigger`` splits are offered at a time. What was offered is logged as well, so that holds for each run
    with ``availableNow`` too, which asks only once; ``streaming.flagstat.drain`` runs it until all is read.
    """

    def __init__(self, options: dict, schema: StructType):
        if "filelog" not in options:
            raise ValueError("streaming=files needs the option fileLog, a folder of its own")
        self.raw, self.log = options, options["filelog"].rstrip("/")
        self.most = int(options.get("maxsplitspertrigger", 1 << 30))
        if self.most < 1:
            raise ValueError("maxSplitsPerTrigger must be at least 1")
        self.options = _Options(options).choose(schema)
        self.planned: list[Split] = []
        self.known: set[str] = set()
        self.entries = 0
        self._recall()
        offered = [int(f.rsplit("-", 1)[1]) for f in list_files(self.log, "") if "/offered-" in f] if self.entries else []
        self.at = max(offered, default=0)

    def _recall(self) -> None:
        """Read the log's entries that are not known yet, in order."""
        while exists(name := f"{self.log}/files-{self.entries:09d}.json"):
            with open_file(name) as file:
                for path, size in json.loads(file.read()):
                    self.known.add(path)
                    self.planned += [Split(path, at, at + self.options.compressed) for at in range(0, max(1, size), self.options.compressed)]
            self.entries += 1

    def _discover(self) -> None:
        self._recall()
        found = [f for f in _files(self.raw, ".bam") if f not in self.known and exists(default_index(f))]
        if found:
            with create(f"{self.log}/files-{self.entries:09d}.json") as out:
                out.write(json.dumps([(f, size_of(f)) for f in found]).encode())
            self._recall()

    def initialOffset(self):
        return {"split": 0}

    def latestOffset(self):
        self._discover()
        at = min(len(self.planned), self.at + self.most)
        if at > self.at:
            create(f"{self.log}/offered-{at}").close()
            self.at = at
        return {"split": self.at}

    def partitions(self, start, end):
        self._recall()
        return self.planned[start["split"] : end["split"]]

    def read(self, partition):
        yield from self.options.read(partition)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return schema_of(*columns(self.options))

    def reader(self, schema):
        return BamReader(self.options, schema)

    def streamReader(self, schema):
        kinds = {"all": BamStreamReader, "bounded": BamStreamReader, "files": FileStreamReader}
        kind = self.options.get("streaming", "all")
        if kind not in kinds:
            raise ValueError(f"unknown streaming {kind!r}; there are {', '.join(kinds)}")
        return kinds[kind](self.options, schema)


class _PerFile(DataSourceReader):
    """One partition a file, and rows by ``rows(path)``."""

    def __init__(self, options: dict, suffix: str, rows):
        self.files, self.rows = _files(options, suffix), rows

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        yield from self.rows(partition.value)


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.mode = _Options(options), options.get("mode", "all")
        if self.mode not in ("all", "prefix", "integrity"):
            raise ValueError(f"unknown mode {self.mode!r}; there are all, prefix, integrity")

    def partitions(self):
        if self.mode == "prefix":
            return [Split(f, 0, 1) for f in self.options.files]
        return self.options.splits()

    def read(self, partition):
        if self.mode == "prefix":
            yield from prefix_rows(partition.path, self.options.uncompressed)
        else:
            yield from (failing_members if self.mode == "integrity" else member_rows)(partition, self.options.index)


def index_rows(path: str):
    _, rows = read_index(path)
    for ordinal, ref, start, packed in rows.tolist():
        yield path, ordinal, ref, start, packed >> 16, packed & 65535


def _member_row(path: str, member) -> tuple:
    return path, member.offset, len(member.raw), member.size, member.is_eof


def _places(split: Split, index: str | None) -> tuple[list[int], int | None]:
    """Offsets at which members are known to begin in a split, the file's begin among them, and where the scan of it ends.

    Without an index a file is read by its first split; others have no places.
    """
    index = index or default_index(split.path)
    starts = _keep("members", split.path, index, lambda: np.unique(read_index(index)[1][:, 3] >> 16))[0] if exists(index) else np.zeros(0, np.int64)
    after = starts[starts >= split.end]
    inside = starts[(starts >= max(1, split.begin)) & (starts < split.end)].tolist()
    return inside if split.begin else [0, *inside], int(after[0]) if len(after) else None


def member_rows(split: Split, index: str | None = None):
    """Members that begin in a split, with the size that each one's trailer states."""
    places, stop = _places(split, index)
    if not places:
        return
    with open_ahead(split.path) as file:
        file.seek(places[0])
        while (stop is None or file.tell() < stop) and (member := read_member(file, split.path)) is not None:
            yield _member_row(split.path, member)


def _begins_member(file, path: str, at: int) -> bool:
    file.seek(at)
    try:
        return read_member(file, path) is not None
    except FormatError:
        return False


def failing_members(split: Split, index: str | None = None):
    """(path, compressed_offset, reason, resumes) of members in a split that cannot be read.

    A member whose frame holds but whose data or stated size do not costs itself alone. Where the frame is broken, all up to the next offset that the index
    names cannot be told apart; ``resumes`` says where the scan went on, null at the end of what can be read.
    """
    places, stop = _places(split, index)
    if not places:
        return
    known = [*places, *([stop] if stop is not None else [])]
    with open_ahead(split.path) as file:
        at = places[0]
        while at is not None and (stop is None or at < stop):
            file.seek(at)
            try:
                member = read_member(file, split.path)
            except FormatError as e:
                # behind the whole member, if another begins there: then only what it states is wrong
                after = file.tell()
                onward = after if _begins_member(file, split.path, after) else next((p for p in known if p > at), None)
                yield split.path, at, str(e).removeprefix(f"{split.path}: "), onward
                at = onward
                continue
            if member is None:
                return
            at = file.tell()
            try:
                member.inflate(split.path)
            except FormatError as e:
                yield split.path, member.offset, str(e).removeprefix(f"{split.path}: "), at


def prefix_rows(path: str, cap: int):
    """Members of the file's front that inflate to at most ``cap`` bytes together; an end marker ends it."""
    total = 0
    with open_ahead(path) as file:
        while (member := read_member(file, path)) is not None and not member.is_eof:
            if total + member.size > cap:
                if not total:
                    raise FormatError(f"{path}: the first member inflates to {member.size} bytes, more than the {cap} asked for")
                return
            total += member.size
            yield _member_row(path, member)
    if not total:
        raise FormatError(f"{path}: there are no members with data")


def header_rows(path: str):
    header = read_header(path)
    with open_file(path) as file:
        yield path, len(header.references), header.first_record >> 16, header.first_record & 65535, data_end(file)


def _source(name: str, suffix: str, schema_text: str, rows) -> type[DataSource]:
    return type(name, (DataSource,), {"name": classmethod(lambda cls: name), "schema": lambda self: schema_text, "reader": lambda self, schema: _PerFile(self.options, suffix, rows)})


BaiSource = _source("bai", ".bai", "path string, ordinal long, ref_id int, window_start long, compressed long, within int", index_rows)


class BgzfSource(DataSource):
    @classmethod
    def name(cls):
        return "bgzf"

    def schema(self):
        if self.options.get("mode") == "integrity":
            return "path string, compressed_offset long, reason string, resumes long"
        return "path string, compressed_offset long, compressed_len int, uncompressed_len int, is_eof boolean"

    def reader(self, schema):
        return BgzfReader(self.options)


HeaderSource = _source("bam_header", ".bam", "path string, reference_count int, first_compressed long, first_within int, data_end long", header_rows)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let it hand predicates to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BamSource, BaiSource, BgzfSource, HeaderSource):
        spark.dataSource.register(source)
