"""Snapshots: one small JSON file per version that names the files of every level, with their key ranges.

A version is published by renaming a finished file to its name, so a reader sees a whole
snapshot or none. The name is taken only once: the second of two writers of one version
fails. That relies on the file system's rename not replacing a file, as HDFS and local disks
do; an object store needs a committer of its own.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import SparkSession

from ..errors import ConflictError, SnapshotError

_NAME = re.compile(r"snapshot-(\d+)\.json")


class File(NamedTuple):
    """A sorted file: its least and greatest key, the bytes of its records, and their number."""

    path: str
    lo: bytes
    hi: bytes
    bytes: int
    records: int

    def touches(self, start: bytes | None, end: bytes | None) -> bool:
        """Whether it may hold a key of an inclusive range; None leaves a side open."""
        return (start is None or self.hi >= start) and (end is None or self.lo <= end)


@dataclass(frozen=True)
class Snapshot:
    """``levels[i]`` holds the files of level ``i``, in order of the key, which don't overlap; the last is the sink. ``next_seq`` is the first free number."""

    version: int = 0
    next_seq: int = 0
    levels: tuple[tuple[File, ...], ...] = ()

    def paths(self, level: int, start: bytes | None = None, end: bytes | None = None) -> list[str]:
        """The files of a level that a range of keys touches."""
        return [f.path for f in self.levels[level] if f.touches(start, end)]

    def dumps(self) -> str:
        levels = [[(f.path, f.lo.hex(), f.hi.hex(), f.bytes, f.records) for f in files] for files in self.levels]
        return json.dumps({"version": self.version, "next_seq": self.next_seq, "levels": levels})

    @classmethod
    def loads(cls, text: str) -> Snapshot:
        try:
            d = json.loads(text)
            levels = tuple(tuple(File(str(p), bytes.fromhex(lo), bytes.fromhex(hi), int(n), int(r)) for p, lo, hi, n, r in x) for x in d["levels"])
            return cls(int(d["version"]), int(d["next_seq"]), levels)
        except (KeyError, TypeError, ValueError) as e:
            raise SnapshotError(f"not a snapshot: {e}") from e


def filesystem(spark: SparkSession, folder: str):
    """(JVM, Hadoop file system, path) of a folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published versions, oldest first; none where the folder doesn't exist."""
    _, fs, path = filesystem(spark, folder)
    if not fs.exists(path):
        return []
    names = (m for s in fs.listStatus(path) if (m := _NAME.fullmatch(s.getPath().getName())))
    return sorted(int(m[1]) for m in names)


def read(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot:
    """A version, by default the newest; the empty version 0 where none was published yet."""
    if version is None:
        found = versions(spark, folder)
        if not found:
            return Snapshot()
        version = found[-1]
    jvm, fs, _ = filesystem(spark, folder)
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot-{version}.json")
    if not fs.exists(path):
        raise SnapshotError(f"no version {version} in {folder}")
    stream = fs.open(path)
    try:
        return Snapshot.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, snapshot: Snapshot) -> None:
    """Makes a version visible, at once and once only."""
    jvm, fs, path = filesystem(spark, folder)
    fs.mkdirs(path)
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot-{snapshot.version}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(snapshot.dumps().encode()))
        out.hflush()
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise ConflictError(f"version {snapshot.version} exists already")
