"""Token ids in binary files, with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents, one after another, as 16-bit (vocabularies up to
65,536) or 32-bit little-endian integers; then the end offset of each document and each document's
id, both Elias-Fano encoded; then a footer. Document i's ids are found by one select each for its
end and its predecessor's, so no table of 64-bit offsets is needed.

    ids | ends | doc ids | footer: id width, nulls, least doc id, bytes of ends, bytes of doc ids,
                                   number of ids (six 64-bit integers), magic (8 bytes)

Files are written in ascending order of doc_id over a range partitioning; a task that is run again
writes a file of another name, and only the files that the manifest names are ever read.

Cases: null text is empty, and its document is the end id alone; rows of equal id stand in order
of their texts; null ids come first; extra columns are ignored; no rows give no file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandtally.files import create, open_file
from strandtally.llm.elias_fano import EliasFano
from strandtally.llm.encode import encoder
from strandtally.llm.textscan import give_back, pieces, take_turn
from strandtally.shared import materialize, new_path

MAGIC = b"STTOKEN1"
READ_IDS = 1 << 20
_MANIFEST = "shard long, path string, n_docs long, n_ids long"


class TokenFileWriter:
    def __init__(self, uri: str, width: int):
        self.out, self.width = create(uri), width
        self.lengths: list[int] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.lengths.append(len(ids))
        self.ids.append(doc_id)

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.array(self.lengths, np.int64))
        nulls = sum(i is None for i in self.ids)
        known = np.array(self.ids[nulls:], np.int64)
        least = int(known[0]) if len(known) else 0
        parts = [EliasFano.encode(ends).dump(), EliasFano.encode(known - least).dump()]
        n_ids = int(ends[-1]) if len(ends) else 0
        self.out.write(b"".join(parts) + np.array([self.width, nulls, least, *map(len, parts), n_ids], "<i8").tobytes() + MAGIC)
        self.out.close()
        return len(self.lengths), n_ids


class TokenFile:
    """A file of documents that are fetched by number."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        foot = self._read(size - 56, 56)
        if foot[48:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.width, self.nulls, self.least, ends, ids, self.n_ids = np.frombuffer(foot[:48], "<i8").tolist()
        self.ends = EliasFano.load(self._read(size - 56 - ids - ends, ends))
        self.doc_ids = EliasFano.load(self._read(size - 56 - ids, ids))

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, first: int, count: int) -> np.ndarray:
        """Start of document ``first``, then the ends of the documents from it on."""
        before = self.ends.select(first - 1, 1) if first else np.zeros(1, np.int64)
        return np.concatenate([before, self.ends.select(first, count)])

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}").astype("<u4")

    def doc_id(self, first: int, count: int) -> list[int | None]:
        nulls = max(0, min(self.nulls - first, count))
        known = self.doc_ids.select(first + nulls - self.nulls, count - nulls) + self.least if count > nulls else []
        return [None] * nulls + [int(x) for x in known]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, doc_col: str = "doc_id", text_col: str = "text", spaced: bool = False, folder: str | None = None) -> DataFrame:
    """Write all documents; gives the manifest (shard, path, n_docs, n_ids), shards in doc_id order."""
    folder = folder or new_path(docs.sparkSession, "token-files")

    def run(batches):
        take_turn("encoder", encoder.cache_clear)
        shard, made, writer = TaskContext.get().partitionId(), encoder(tokenizer, spaced), None
        width = 2 if max(made.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.tokens"
        for batch in batches:
            for part in pieces(batch, 4096):
                writer = writer or TokenFileWriter(path, width)
                for doc, raw in zip(part.column(0).to_pylist(), made.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    writer.add(doc, np.append(raw, np.uint32(end_id)))
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})
        give_back()

    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, first = TokenFile(path), 0
                while first < len(file):
                    bounds = file.bounds(first, 4096)
                    count = max(1, int(np.searchsorted(bounds, bounds[0] + READ_IDS, side="right")) - 1)
                    count = min(count, len(bounds) - 1)
                    ids = file.ids(int(bounds[0]), int(bounds[count]))
                    at = (bounds[: count + 1] - bounds[0]).tolist()
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_id(first, count), pa.int64()), pa.array(bounds[:count] + base), pa.array(np.diff(bounds[: count + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    first += count

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    files = max(1, manifest.count())
    return based.repartition(files, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path(), end_id=2))
