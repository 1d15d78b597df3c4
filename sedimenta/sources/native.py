"""Native sorted-string files and their manifests, as a Spark data source that reads and writes them.

A file is data blocks, then a block index, then the index's offset in its last eight bytes; all
numbers are big-endian. A record is a length byte and the key, then a length byte and the
value; an empty value is a tombstone and becomes null. Blocks may be padded: the index says how
many bytes of each are in use. A scan's partitions are files, small ones together and large ones in parts of ``SPLIT`` bytes;
block indexes are read by the tasks, not the driver, and a key range given as options leaves out the blocks that it doesn't touch.
Rows travel as Arrow batches. Files may lie on any file system that Arrow knows.

    spark.dataSource.register(NativeRuns)
    spark.read.format("sorted_runs").option("path", file).option("start", "6b31").load()
    spark.read.format("sorted_runs").option("manifest", path).load()          # all files of all levels
    df.sortWithinPartitions("key").write.format("sorted_runs").mode("append").save(folder)

Writing gives a file for each partition, more where ``run_size`` is reached; its keys must be in order, without
repeats. Keys and values have at most 255 bytes there, as a length is one byte.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import SnapshotError, StoreError
from .folders import open_fs

SCHEMA = "key binary, value binary, file string, block int"
#: Bytes of files that a task reads, and records of a batch.
SPLIT, BATCH = 128 << 20, 10_000


@dataclass(frozen=True)
class Block:
    start: bytes
    end: bytes
    used: int
    offset: int

    def touches(self, start: bytes | None, end: bytes | None) -> bool:
        return (start is None or self.end >= start) and (end is None or self.start <= end)


def _take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if n < 0 or at + n > len(data):
        raise StoreError("the file ends too early")
    return data[at : at + n], at + n


def _short(data: bytes, at: int) -> tuple[bytes, int]:
    size, at = _take(data, at, 1)
    return _take(data, at, size[0])


def block_index(path: str) -> list[Block]:
    """The blocks that a file's footer lists."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        return _index(f)


def _index(f: pa.NativeFile) -> list[Block]:
    total = f.size()
    if total < 16:
        raise StoreError("too short for a footer")
    at = struct.unpack(">q", f.read_at(8, total - 8))[0]
    if not 0 <= at <= total - 16:
        raise StoreError("the footer points outside the file")
    data = f.read_at(total - 8 - at, at)
    n, at, out = struct.unpack_from(">q", data)[0], 8, []
    for _ in range(n):
        start, at = _short(data, at)
        end, at = _short(data, at)
        raw, at = _take(data, at, 16)
        out.append(Block(start, end, *struct.unpack(">qq", raw)))
    return out


def _records(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    at = 0
    while at < len(data):
        key, at = _short(data, at)
        value, at = _short(data, at)
        yield key, value or None


# writing


def write_file(path: str, records: Iterable[tuple[bytes, bytes | None]], block_size: int = 4096) -> list[Block]:
    """Writes records, which must be in order of the key, and returns the blocks; a record larger than a block has one of its own."""
    blocks: list[Block] = []
    fs, at = open_fs(path)
    with fs.open_output_stream(at, compression=None) as f:
        held, start, last, offset = b"", None, None, 0

        def close() -> None:
            nonlocal held, start, offset
            blocks.append(Block(start, last, len(held), offset))
            padded = held.ljust(block_size, b"\0")
            f.write(padded)
            offset += len(padded)
            held, start = b"", None

        for key, value in records:
            value = value or b""
            if last is not None and key <= last:
                raise StoreError("keys must be in order and occur once")
            if not key or len(key) > 255 or len(value) > 255:
                raise StoreError("a native file takes keys of 1 to 255 bytes and values of at most 255")
            raw = bytes([len(key)]) + key + bytes([len(value)]) + value
            if start is not None and len(held) + len(raw) > block_size:
                close()
            start = key if start is None else start
            held += raw
            last = key
        if start is not None:
            close()
        index = struct.pack(">q", len(blocks))
        for b in blocks:
            index += bytes([len(b.start)]) + b.start + bytes([len(b.end)]) + b.end + struct.pack(">qq", b.used, b.offset)
        f.write(index + struct.pack(">q", offset))
    return blocks


def write_manifest(path: str, levels: list[list[str]]) -> None:
    """Names the files of every level; written under a draft name and renamed, so a reader sees all of it or nothing."""
    out = struct.pack(">I", len(levels))
    for files in levels:
        out += struct.pack(">I", len(files))
        for name in files:
            raw = name.encode()
            if len(raw) > 255:
                raise SnapshotError("a native manifest takes paths of at most 255 bytes")
            out += bytes([len(raw)]) + raw
    fs, at = open_fs(path)
    draft = f"{at}.draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as f:
        f.write(out)
    fs.move(draft, at)


def read_manifest(path: str) -> list[list[str]]:
    """File paths of every level."""
    fs, place = open_fs(path)
    with fs.open_input_stream(place, compression=None) as f:
        data = f.read()
    try:
        levels, at, out = struct.unpack_from(">I", data)[0], 4, []
        for _ in range(levels):
            n = struct.unpack_from(">I", data, at)[0]
            at += 4
            files = []
            for _ in range(n):
                name, at = _short(data, at)
                files.append(name.decode())
            out.append(files)
    except (struct.error, StoreError) as e:
        raise SnapshotError(f"not a manifest: {e}") from e
    return out


class _Part(InputPartition):
    """Files, each with the range of places where the blocks begin that are the task's."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if "manifest" in options:
            self.paths += [p for files in read_manifest(options["manifest"]) for p in files]
        self.start = bytes.fromhex(options["start"]) if "start" in options else None
        self.end = bytes.fromhex(options["end"]) if "end" in options else None

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for path in self.paths:
            fs, at = open_fs(path)
            n = fs.get_file_info(at).size or 0
            for lo in range(0, max(1, n), SPLIT):
                take = min(SPLIT, n - lo)
                if held and size + take > SPLIT:
                    parts.append(_Part(held))
                    held, size = [], 0
                held.append((path, lo, lo + SPLIT))
                size += take
        return parts + [_Part(held)] if held or not parts else parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for path, lo, hi in partition.files:
            fs, at = open_fs(path)
            with fs.open_input_file(at) as f:
                rows = []
                for number, b in enumerate(_index(f)):
                    if lo <= b.offset < hi and b.touches(self.start, self.end):
                        rows += [(k, v, number) for k, v in _records(f.read_at(b.used, b.offset)) if (self.start is None or k >= self.start) and (self.end is None or k <= self.end)]
                    if len(rows) >= BATCH:
                        yield _batch(rows, path)
                        rows = []
                yield _batch(rows, path)


def _batch(rows: list[tuple[bytes, bytes | None, int]], path: str) -> pa.RecordBatch:
    keys, values, blocks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array([path] * len(rows), pa.string()), pa.array(blocks, pa.int32())], ["key", "value", "file", "block"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.block_size = int(options.get("block_size", 4096))
        self.run_size = int(options.get("run_size", SPLIT))

    def write(self, rows: Iterator[Row]) -> _Written:
        fs, root = open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        files: list[str] = []
        ahead = next(rows, None)

        def run() -> Iterator[tuple[bytes, bytes | None]]:
            nonlocal ahead
            size = 0
            while ahead is not None and (not size or size + len(ahead["key"]) + len(ahead["value"] or b"") + 2 <= self.run_size):
                size += len(ahead["key"]) + len(ahead["value"] or b"") + 2
                yield bytes(ahead["key"]), None if ahead["value"] is None else bytes(ahead["value"])
                ahead = next(rows, None)

        while ahead is not None:
            name = f"{self.folder}/.{uuid.uuid4().hex}"
            write_file(name, run(), self.block_size)
            files.append(name)
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for name in message.files if message else ():
                fs, at = open_fs(name)
                folder, _, base = at.rpartition("/")
                fs.move(at, f"{folder}/{base[1:]}.sst")  # files of lost or failed tasks keep their hidden names

    def abort(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for name in message.files if message else ():
                fs, at = open_fs(name)
                fs.delete_file(at)


class NativeRuns(DataSource):
    """Options of a read: ``path`` (one or several files, with commas), ``manifest``, ``start`` and ``end`` (keys in hex, both
    included); of a write: ``path`` (a folder), ``block_size`` and ``run_size`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return "sorted_runs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))
