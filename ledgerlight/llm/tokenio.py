"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in ascending document order: frames of whole documents' ids (each a zstandard frame of its own,
about ``FRAME`` bytes before compression, a longer document alone in one); a skippable frame with the document
index; and the seek table of the zstandard seekable format, a skippable frame that ends the file: for each
frame its compressed size, its size and the low 32 bits of the XXH64 of its content, then the footer. A reader takes the
footer, the seek table and the index, and decompresses only the frames of the documents that it wants, checking
each frame's sum. Any zstandard tool can decompress the whole file.

Files are written by tasks to the shared folder under a name of the attempt and renamed when whole, so a lost
executor or a repeated task leaves the same file, and what a lost attempt had begun is removed. The manifest, a Parquet table beside them, has one row per file.

Defined cases: a null or empty text is its end id alone; null ids come first; rows of the same id follow in the order
of their text's hash; an empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import before, fresh_path
from .tokens import encoder

FRAME = 256 * 1024
LEVEL = 3
#: Text to a file where the number of files is left open.
FILE_BYTES = 64 << 20
# Fixed values of the zstandard (seekable) format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

MANIFEST = "part int, file string, docs long, tokens long, bytes long"


class Writer:
    """Writes one file; ``add`` in document order, then ``close``."""

    def __init__(self, sink, dtype: np.dtype, frame: int = FRAME):
        import zstandard

        self.sink, self.dtype, self.frame = sink, dtype, frame
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.held, self.held_bytes, self.table, self.ids, self.counts, self.frames = [], 0, [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.frames.append(len(self.table))
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.frame:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.held:
            data = b"".join(self.held)
            packed = self.zstd.compress(data)
            self.sink.write(packed)
            self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.held_bytes = [], 0

    def close(self) -> int:
        self.flush()
        n = len(self.ids)
        index = struct.pack("<QB", n, self.dtype.itemsize) + b"".join(
            (
                np.array([x is not None for x in self.ids], "u1").tobytes(),
                np.array([x or 0 for x in self.ids], "<i8").tobytes(),
                np.array(self.counts, "<i8").tobytes(),
                np.array(self.frames, "<u4").tobytes(),
            )
        )
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        rows = b"".join(struct.pack("<III", *row) for row in self.table)
        seek = rows + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(seek)) + seek)
        return sum(row[0] for row in self.table) + len(index) + len(seek) + 16


class Reader:
    """``doc_ids``, ``counts`` and ``starts`` (in the file) of all documents; ``ids(i)`` decompresses the i-th one's frame only."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_FOOTER or not flags & WITH_CHECKSUMS:
            raise ValueError("the file has no seek table with checksums")
        begin = size - 9 - 12 * count - 8
        self.table = np.frombuffer(self._at(begin + 8, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        index = self._at(at + 8, length)
        if magic != SKIPPABLE_INDEX or at + 8 + length != begin:
            raise ValueError("the document index is not where it should be")
        n, width = struct.unpack_from("<QB", index)
        known = np.frombuffer(index, "u1", n, 9)
        self.dtype = np.dtype(f"<u{width}")
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(index, "<i8", n, 9 + n), known, strict=True)]
        self.counts = np.frombuffer(index, "<i8", n, 9 + 9 * n)
        self.frames = np.frombuffer(index, "<u4", n, 9 + 17 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        first = np.searchsorted(self.frames, np.arange(count))
        self.frame_starts = self.starts[first]
        self.decompressed, self._held = 0, (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def _frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        if self._held[0] != k:
            packed, size, checksum = (int(x) for x in self.table[k])
            data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} is damaged")
            self._held, self.decompressed = (k, data), self.decompressed + 1
        return self._held[1]

    def ids(self, i: int) -> np.ndarray:
        k = int(self.frames[i])
        begin = int(self.starts[i] - self.frame_starts[k]) * self.dtype.itemsize
        return np.frombuffer(self._frame(k), self.dtype, int(self.counts[i]), begin)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, files: int | None = None, frame: int = FRAME) -> DataFrame:
    """Encodes all documents into files under ``folder`` in ascending doc_id order; returns the manifest, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end, writer, tokens = np.array([end_id], enc.dtype).tobytes(), None, 0
        store, root = fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}.ids.zst"
        attempt = f"{root}/.{name}-{uuid.uuid4().hex}"
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    rows = batch.slice(at, 1_000)
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        sink = store.open_output_stream(attempt)
                        writer = Writer(sink, enc.dtype, frame)
                    for doc_id, ids in zip(rows["doc_id"].to_pylist(), enc.ids(rows["text"].to_pylist()), strict=True):
                        writer.add(doc_id, ids + end)
            if writer:
                size = writer.close()
                sink.close()
                store.move(attempt, f"{root}/{name}")
        except BaseException:
            if writer:
                sink.close()
                store.delete_file(attempt)
            raise
        if writer:
            tokens = sum(writer.counts)
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "docs": len(writer.ids), "tokens": tokens, "bytes": size}],
                pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]),
            )

    ship(docs.sparkSession)
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not files:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    _clear(docs.sparkSession, folder)
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _clear(spark: SparkSession, folder: str) -> None:
    """Removes what attempts that were lost on the way have left; the whole files have their names by now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.part-*")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in store.globStatus(path) or []:
        store.delete(left.getPath(), False)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    reader = Reader(source)
                    for at in range(0, len(reader.doc_ids), 10_000):
                        which = range(at, min(at + 10_000, len(reader.doc_ids)))
                        yield pa.record_batch(
                            {
                                "doc_id": pa.array([reader.doc_ids[i] for i in which], pa.int64()),
                                "start": pa.array(reader.starts[which.start : which.stop] + row["before"], pa.int64()),
                                "n_tokens": pa.array(reader.counts[which.start : which.stop], pa.int64()),
                                "ids_crc32": pa.array([zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in which], pa.int64()),
                                "file": pa.array([row["file"]] * len(which), pa.string()),
                            }
                        )

    ship(manifest.sparkSession)
    files = before(manifest.select("part", "file", "tokens"), "part", [], "tokens", 3).select("file", "before")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``write`` into a fresh folder beside the checkpoints, then ``read``."""
    folder = fresh_path(docs.sparkSession, "token-files")
    return read(write(docs, folder, path, end_id), folder)
