"""WARC archives as chunked record tables.

A payload of any size is a run of rows (record, chunk number, bytes) with chunks of at most
``chunk_bytes``. The scan cuts payloads into such rows, so only chunks are shuffled and sorted, by record and
number. The writer takes them one by one, compresses each chunk as it comes and keeps
a running SHA-1, so no task ever holds a whole record besides the input row it came from. The
reader streams archives back into the same kind of rows; each carries the number of bytes and the
digest of the payload up to and with it, so a record's length and digest stand in its last row.

A record whose payload occurred before (the smallest record id has it) is a ``revisit``: HTTP
headers with the payload's length, its digest and the id it refers to, no payload. Each record is
a gzip member of its own. A task that runs again writes a file of another name, and only the files
that the manifest names are read.

Cases: a null payload is empty (and digested as such); equal rows are written each; of rows with
equal payload and the same, smallest id all are responses; a null id is a response, and never what
others refer to; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandtally.files import create, open_file
from strandtally.llm.components import with_group_min
from strandtally.shared import materialize, new_path

CHUNK_BYTES = 1 << 20
_READ = 1 << 16
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Per id and payload: record_id, digest (hex SHA-1), payload_bytes, refers_to (null for a response)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("record_id"), F.sha1(payload).alias("digest"), F.length(payload).cast("long").alias("payload_bytes")).distinct()
    out = with_group_min(rows, "digest", "record_id", "least")
    return out.select("record_id", "digest", "payload_bytes", F.when((F.col("least") < F.col("record_id")) & (F.col("payload_bytes") >= least_bytes), F.col("least")).alias("refers_to"))


def payload_chunks(pages: DataFrame, known: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages``; the chunks of a record follow each other in a partition.

    Before the chunks of all records of one id and digest stands a row of number -1 that says what they
    refer to; records without an id have none.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), payload.alias("payload"), F.monotonically_increasing_id().alias("copy"))
    rows = rows.select("id", "uri", "copy", "payload", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("payload_bytes"))
    last = F.floor(F.greatest(F.col("payload_bytes") - 1, F.lit(0)) / chunk_bytes).cast("int")
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    own = F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    chunks = cut.select(F.col("id").cast("string").alias("record_id"), "uri", "digest", "payload_bytes", F.lit(None).cast("string").alias("refers_to"), "copy", "chunk_no", own.alias("data"))
    none = lambda kind: F.lit(None).cast(kind)
    # records without an id refer to nothing, and need no head
    heads = known.where("record_id is not null").select(F.col("record_id").cast("string").alias("record_id"), none("string").alias("uri"), "digest", "payload_bytes", F.col("refers_to").cast("string").alias("refers_to"), F.lit(-1).cast("long").alias("copy"), F.lit(-1).alias("chunk_no"), none("binary").alias("data"))
    together = chunks.union(heads).withColumn("spread", F.when(F.col("record_id").isNull(), F.xxhash64("copy")))
    return together.repartition("record_id", "spread").sortWithinPartitions("record_id", "digest", "copy", "chunk_no").drop("spread", "copy")


class WarcWriter:
    """Writes records chunk by chunk, each as one gzip member."""

    def __init__(self, uri: str, date: str):
        self.out, self.date, self.records = create(uri), date, 0

    def begin(self, record_id: str | None, uri: str | None, digest: str, size: int, refers_to: str | None) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        fields = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:record:{'' if record_id is None else record_id}>", f"WARC-Date: {self.date}"]
        if uri is not None:
            fields.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
        fields += [f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digest))}", "Content-Type: application/http; msgtype=response"]
        if refers_to is not None:
            fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
        fields.append(f"Content-Length: {len(http) + (0 if refers_to is not None else size)}")
        self.pack, self.sha1, self.left, self.digest = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), 0 if refers_to is not None else size, digest
        self.revisit = refers_to is not None
        self.out.write(self.pack.compress("\r\n".join(fields).encode() + _END + http))

    def add(self, data: bytes) -> None:
        self.sha1.update(data)
        self.left -= len(data)
        self.out.write(self.pack.compress(data))

    def end(self) -> None:
        if self.left or (not self.revisit and self.sha1.hexdigest() != self.digest):
            raise ValueError("the chunks do not add up to the record's payload")
        self.out.write(self.pack.compress(_END) + self.pack.flush())
        self.records += 1


def write_archives(chunks: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a chunked record table; gives the manifest (path, records)."""
    folder = folder or new_path(chunks.sparkSession, "warc")

    def run(batches):
        path, writer, open_, refers_to = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, False, None
        for batch in batches:
            head = [batch.column(i).to_pylist() for i in range(6)]
            for i, (record_id, uri, digest, size, target, chunk_no) in enumerate(zip(*head, strict=True)):
                if chunk_no < 0:
                    refers_to = target
                    continue
                writer = writer or WarcWriter(path, date)
                if chunk_no == 0:
                    if open_:
                        writer.end()
                    refers_to = None if record_id is None else refers_to
                    writer.begin(record_id, uri, digest, size, refers_to)
                    open_ = True
                if refers_to is None:
                    writer.add(batch.column(6)[i].as_py())
        if writer:
            writer.end()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [writer.records]})

    return materialize(chunks.mapInArrow(run, "path string, records long"), "warc-manifest")


class _Stream:
    """Inflated bytes of consecutive gzip members, a buffer at a time."""

    def __init__(self, file):
        self.file, self.inflate, self.buffer, self.raw, self.begun = file, zlib.decompressobj(31), b"", b"", False

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                self.begun = bool(self.raw)
            if not self.raw and not self.inflate.unconsumed_tail:
                self.raw = self.file.read(_READ)
                if not self.raw:
                    if self.begun and not self.inflate.eof:
                        raise ValueError("an archive ends within a gzip member")
                    return False
                self.begun = True
            got = self.inflate.decompress(self.inflate.unconsumed_tail or self.raw, _READ)
            self.raw = b""
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("an archive ends within a record's header")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(file, chunk_bytes: int = CHUNK_BYTES):
    """Rows of the chunked record table of one archive: see ``read_archives``."""
    stream = _Stream(file)
    while (head := stream.until(_END)) is not None:
        warc = _fields(head.lstrip(b"\r\n"))
        left = int(warc["content-length"])
        http = stream.until(_END)
        left -= len(http) + len(_END)
        kind, named = warc["warc-type"], warc["warc-record-id"].removeprefix("<urn:record:").removesuffix(">")
        refers_to = warc["warc-refers-to"].removeprefix("<urn:record:").removesuffix(">") if kind == "revisit" else None
        declared = warc["warc-payload-digest"].removeprefix("sha1:")
        sha1, done, chunk_no, size = hashlib.sha1(), 0, 0, left
        if kind == "revisit":
            yield named or None, kind, refers_to, 0, b"", int(_fields(http)["content-length"]), declared, True
        else:
            while True:
                data = stream.take(min(chunk_bytes, left))
                sha1.update(data)
                done, left = done + len(data), left - len(data)
                if not data and left:
                    raise ValueError("an archive ends within a record")
                if not left and base32(sha1.digest()) != declared:
                    raise ValueError(f"record {named} differs from its digest")
                yield named or None, kind, None, chunk_no, data, done, base32(sha1.copy().digest()), done == size
                chunk_no += 1
                if not left:
                    break
        stream.take(len(_END))


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives: record_id, record_type, refers_to, chunk_no, data, bytes_so_far, digest_so_far, last.

    ``digest_so_far`` is the base32 SHA-1 of the payload's first ``bytes_so_far`` bytes; a revisit has one row
    with the length and digest of the payload that it stands for. Without ``with_data`` only last rows come, without bytes.
    """
    names = ["record_id", "record_type", "refers_to", "chunk_no", "data", "bytes_so_far", "digest_so_far", "last"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches):
        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_file(path) as file:
                    for row in records(file, chunk_bytes):
                        if not with_data:
                            if not row[-1]:
                                continue
                            row = (*row[:4], None, *row[5:])
                        rows.append(row)
                        held += len(row[4] or b"") + 100
                        if held > 4 * CHUNK_BYTES:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files, "path").mapInArrow(run, "record_id string, record_type string, refers_to string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean")


def op1_warc_chunks(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    known = materialize(revisits(pages), "warc-revisits")
    back = read_archives(write_archives(payload_chunks(pages, known)), with_data=False)
    return back.where("last").select(F.col("record_id").cast("long").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
with h as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
m as (select h.*, min(page_id) over (partition by d) as least from h)
select page_id, cast(n as bigint) as payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(d, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint), 1)), '') as payload_digest,
case when least < page_id then 'revisit' else 'response' end as record_type, case when least < page_id then least end as refers_to from m"""
