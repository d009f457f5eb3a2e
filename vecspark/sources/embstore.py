"""Fixed-width binary embedding files as a data source ("embstore").

Layout, little-endian: a 4-byte count, then records of an 8-byte id, an 8-byte date and the
vector (4-byte floats or single bytes). Records are of equal width, so one file is read by
many tasks, each from its own offset. A file whose size fits only the other encoding is
a CodecMismatch; any other size is an InvalidEmbeddingStoreFile.

    spark.dataSource.register(EmbeddingFileSource)
    spark.read.format("embstore").options(dim=64, encoding="f32").load(path)
    df.write.format("embstore").options(dim=64, encoding="qint8").mode("overwrite").save(folder)

A written folder holds one complete file for each task; a path may be a file or such a folder.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vecspark.schema import CodecMismatch, Encoding, InvalidEmbeddingDimension, InvalidEmbeddingStoreFile, stored_schema

HEADER = struct.Struct("<i")
RECORDS = 50_000


def record_type(dim: int, encoding: Encoding) -> np.dtype:
    return np.dtype([("id", "<i8"), ("date", "<i8"), ("v", "<f4" if encoding is Encoding.F32 else "i1", (dim,))])


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def files(path: str) -> list[str]:
    path = local_path(path)
    if os.path.isdir(path):
        return sorted(str(p) for p in Path(path).iterdir() if p.is_file() and not p.name.startswith(("_", ".")))
    return [path]


def checked_count(path: str, dim: int, encoding: Encoding) -> int:
    """The number of records, after checking the file's size against its header."""
    size = os.path.getsize(path)
    if size < HEADER.size:
        raise InvalidEmbeddingStoreFile(f"{path}: no header")
    with open(path, "rb") as f:
        (count,) = HEADER.unpack(f.read(HEADER.size))
    if count < 0:
        raise InvalidEmbeddingStoreFile(f"{path}: negative count")
    fits = lambda e: HEADER.size + count * record_type(dim, e).itemsize == size
    if not fits(encoding):
        other = Encoding.QINT8 if encoding is Encoding.F32 else Encoding.F32
        if count and fits(other):
            raise CodecMismatch(f"{path} holds {other.value} vectors")
        raise InvalidEmbeddingStoreFile(f"{path}: size does not fit {count} records")
    return count


def write_file(path: str, ids: np.ndarray, dates: np.ndarray, vectors: np.ndarray) -> None:
    """Writes one file through a temporary one."""
    encoding = Encoding.QINT8 if vectors.dtype == np.int8 else Encoding.F32
    records = np.zeros(len(ids), record_type(vectors.shape[1] if vectors.ndim == 2 else 0, encoding))
    records["id"], records["date"], records["v"] = ids, dates, vectors
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "wb") as f:
        f.write(HEADER.pack(len(ids)))
        f.write(records.tobytes())
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def append_file(path: str, ids: np.ndarray, dates: np.ndarray, vectors: np.ndarray) -> None:
    """Adds records behind the last one, then raises the count."""
    encoding = Encoding.QINT8 if vectors.dtype == np.int8 else Encoding.F32
    count = checked_count(path, vectors.shape[1], encoding)
    records = np.zeros(len(ids), record_type(vectors.shape[1], encoding))
    records["id"], records["date"], records["v"] = ids, dates, vectors
    with open(path, "r+b") as f:
        f.seek(0, os.SEEK_END)
        f.write(records.tobytes())
        f.flush()
        f.seek(0)
        f.write(HEADER.pack(count + len(ids)))
        f.flush()
        os.fsync(f.fileno())


def update_file(path: str, ids: np.ndarray, dates: np.ndarray, vectors: np.ndarray) -> int:
    """Overwrites records in place by id; returns how many of the given rows were found."""
    encoding = Encoding.QINT8 if vectors.dtype == np.int8 else Encoding.F32
    count = checked_count(path, vectors.shape[1], encoding)
    if not count:
        return 0
    kind = record_type(vectors.shape[1], encoding)
    held = np.memmap(path, kind, "r+", HEADER.size, (count,))
    place = {int(i): n for n, i in enumerate(held["id"])}
    done = 0
    for i, d, v in zip(ids.tolist(), dates.tolist(), vectors, strict=True):
        if i in place:
            held[place[i]] = (i, d, v)
            done += 1
    held.flush()
    return done


@dataclass
class Range(InputPartition):
    path: str
    start: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.dim, self.encoding, self.path = int(options["dim"]), Encoding(options.get("encoding", "f32")), options["path"]
        self.records = int(options.get("records", RECORDS))

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            n = checked_count(path, self.dim, self.encoding)
            out += [Range(path, at, min(self.records, n - at)) for at in range(0, n, self.records)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kind = record_type(self.dim, self.encoding)
        if not part.count:
            return
        for at in range(part.start, part.start + part.count, 10_000):
            n = min(10_000, part.start + part.count - at)
            got = np.fromfile(part.path, kind, n, offset=HEADER.size + at * kind.itemsize)
            flat = pa.array(np.ascontiguousarray(got["v"]).ravel())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dim), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got["id"])), pa.array(np.ascontiguousarray(got["date"])), vectors], names=["id", "date", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.dim, self.encoding, self.path, self.overwrite = int(options["dim"]), Encoding(options.get("encoding", "f32")), local_path(options["path"]), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        kind, name, count = record_type(self.dim, self.encoding), f"part-{uuid.uuid4().hex}.bin", 0
        temp = f"{self.path}/.{name}"
        with open(temp, "wb") as f:
            f.write(HEADER.pack(0))
            for b in batches:
                vectors = b.column("embedding")
                size = np.diff(np.asarray(vectors.offsets))
                if vectors.null_count or (size != self.dim).any():
                    raise InvalidEmbeddingDimension(f"embeddings must have {self.dim} dimensions")
                records = np.zeros(b.num_rows, kind)
                records["id"], records["date"] = np.asarray(b.column("id")), np.asarray(b.column("date"))
                records["v"] = np.asarray(vectors.flatten()).reshape(-1, self.dim)
                f.write(records.tobytes())
                count += b.num_rows
            f.seek(0)
            f.write(HEADER.pack(count))
        return Written(name if count else None)

    def commit(self, messages: list[Written | None]) -> None:
        kept = {m.name for m in messages if m is not None and m.name}
        if self.overwrite:
            for p in Path(self.path).glob("part-*.bin"):
                p.unlink()
        for p in Path(self.path).glob(".part-*.bin"):
            if p.name[1:] in kept:
                p.rename(p.with_name(p.name[1:]))
            else:
                p.unlink()

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                Path(self.path, f".{m.name}").unlink(missing_ok=True)


class EmbeddingFileSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "embstore"

    def schema(self):
        return stored_schema(Encoding(self.options.get("encoding", "f32")))

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)
