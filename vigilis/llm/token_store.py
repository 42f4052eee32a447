"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

Layout of a file (the public zstandard seekable format):

- one zstandard frame for each document: its ids, little-endian unsigned 16- or 32-bit;
- one zstandard frame with the catalogue: JSON of the ids' width and place of the file, then the documents' ids (int64) and nulls (uint8);
- a skippable frame with the seek table: for each frame compressed size, plain size, XXH64's low 32 bits of the plain bytes;
  then the frame count, a descriptor byte (128: with checksums) and the magic number.

A reader takes the seek table and the catalogue from a file's end and decompresses only the frames of the documents asked for.

Files are written by Spark's own writer and commit protocol, so a lost executor's attempt leaves nothing behind: a row is
a whole file but for the format's last four bytes, which are the writer's line separator; one row makes one file.

Defined results: null text is an empty text (one end id); a null doc_id sorts first and reads back as null; repeated rows are
kept, each with a frame of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilis.llm.common import need, new_path, written
from vigilis.llm.tokens import batches, encoder

# Fixed values of the zstandard seekable format.
SKIPPABLE, MAGIC, CHECKSUMS = 0x184D2A5E, b"\xb1\xea\x92\x8f", 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


class FileBuilder:
    """Frames of one file, in memory until ``bytes()``."""

    def __init__(self, width: int, part: int, chunk: int, level: int):
        import zstandard

        self.head = {"width": width, "part": part, "chunk": chunk}
        self.zip = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.size = 0

    def _frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.zip.compress(plain)
        self.frames.append(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.size += len(packed)

    def add(self, doc_id: int | None, plain: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self._frame(plain)

    def bytes(self) -> bytes:
        """The file without MAGIC, which the writer puts behind it."""
        head = json.dumps(self.head).encode()
        self._frame(struct.pack("<I", len(head)) + head + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes())
        table = np.array(self.table, ENTRY).tobytes()
        tail = struct.pack("<IB", len(self.table), CHECKSUMS)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table) + len(tail) + len(MAGIC)), table, tail])


class FileReader:
    """Random access to one file's bytes."""

    def __init__(self, content: bytes):
        import zstandard

        self.content, self.unzip = memoryview(content), zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IB4s", self.content[-9:])
        if magic != MAGIC or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        self.table = np.frombuffer(self.content[-9 - n * ENTRY.itemsize : -9], ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        last = self.frame(n - 1)
        size = struct.unpack("<I", last[:4])[0]
        self.head = json.loads(last[4 : 4 + size])
        rest = last[4 + size :]
        self.doc_ids = np.frombuffer(rest[: 8 * (n - 1)], "<i8")
        self.nulls = np.frombuffer(rest[8 * (n - 1) :], "u1").astype(bool)
        self.dtype = np.dtype(f"<u{self.head['width']}")

    def frame(self, i: int) -> bytes:
        """Frame ``i`` alone is decompressed; a wrong checksum raises."""
        import xxhash

        plain = self.unzip.decompress(bytes(self.content[self.at[i] : self.at[i + 1]]), max_output_size=int(self.table["plain"][i]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["check"][i]:
            raise ValueError(f"frame {i}: wrong checksum")
        return plain

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frame(i), self.dtype).astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, file_bytes: int = 8 << 20, partitions: int | None = None, level: int = 1) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order to files of about ``file_bytes`` under ``path``."""
    need(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text"))

    def encode(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced)
        end = np.array([end_id], enc.dtype).tobytes()
        part, chunk, new = TaskContext.get().partitionId(), 0, None
        for page in pages:
            pa.default_memory_pool().release_unused()
            ids, texts = page.column(0).to_pylist(), page.column(1).to_pylist()
            for cut in batches(texts):
                for doc_id, plain in zip(ids[cut], enc.encode(texts[cut]), strict=True):
                    new = new or FileBuilder(enc.dtype.itemsize, part, chunk, level)
                    new.add(doc_id, plain + end)
                    if new.size >= file_bytes:
                        yield pa.RecordBatch.from_pydict({"file": [new.bytes()]})
                        chunk, new = chunk + 1, None
        if new:
            yield pa.RecordBatch.from_pydict({"file": [new.bytes()]})

    files = ranged.mapInArrow(encode, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents in the files under ``path``, or those of ``doc_ids`` alone, whose frames are the only ones decompressed.

    doc_id, part, chunk, place (order of files, and in a file), n_tokens, ids_crc32 and, if asked for, ids.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    schema = "doc_id long, part int, chunk int, place int, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: len(names)]

    def decode(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in pages:
            for content in page.column(0):
                file, rows = FileReader(content.as_py()), []
                for i, doc_id in enumerate(file.doc_ids.tolist()):
                    own = None if file.nulls[i] else doc_id
                    if wanted is None or own in wanted:
                        ids = file.document(i)
                        rows.append((own, file.head["part"], file.head["chunk"], i, len(ids), zlib.crc32(ids.tobytes())) + ((ids.tolist(),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files with ``start``: the ids of all documents before it. One pass over the files.

    Only the files' totals meet in one place to be summed up: one row for each file of about 8 MB, so some ten million rows
    of three numbers at 100 TB, which one task sorts.
    """
    rows = written(read_tokens(spark, path), "token-index")
    total = rows.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("own"))
    before = F.sum("own").over(Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = total.select("part", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("within", F.coalesce(within, F.lit(0))).join(base, ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "part", "chunk", "place")


def tokens_of(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True) -> DataFrame:
    """Writes ``docs`` to new files in the shared folder and reads them back: ``token_index``."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, spaced)
    return token_index(docs.sparkSession, path)
