"""The table: upserts and deletes in, point and range reads out."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadRangeError, ClosedError, EmptyKeyError, EmptyValueError, KeyTooLargeError, ValueTooLargeError
from .operators.cache import ShardedCache
from .operators.cursor import Cursor
from .operators.merge import RECORD, get, merge, multi_get, range_scan
from .options import Options
from .plans.compaction import flush
from .sources import runs, snapshots


class Table:
    """An ordered key/value table over runs in one folder.

    Single mutations are staged on the driver up to ``memtable_size`` bytes and then flushed in the
    background: the memtable is swapped for a new one, and reads see both until the flush is published.
    ``apply`` commits a DataFrame of any size. A commit publishes one new version, so readers see all
    of it or nothing, and older versions stay readable. Reads see staged mutations and go on
    working after ``close``. A flush that fails loses nothing: what it held is staged again, under
    what was written since, and the error is raised by the next ``commit``, ``apply`` or ``close``.

    Any number of threads may write and read. One of them commits at a time; the others wait.
    """

    def __init__(self, spark: SparkSession, options: Options, version: int | None = None):
        self.spark, self.options = spark, options.check()
        self.snapshot = snapshots.read(spark, options.path, version)
        self._staged: dict[bytes, tuple[bytes | None, int]] = {}
        self._flushing: dict[bytes, tuple[bytes | None, int]] = {}
        self._bytes = 0
        self._next = self.snapshot.next_seq
        self._closed = False
        self._as_of = version is not None
        self._lock = threading.RLock()  # of what is above, held for a moment only
        self._commits = threading.Lock()  # one commit at a time
        self._flusher: threading.Thread | None = None
        self._failed: Exception | None = None
        each = [options.level(i) for i in range(len(options.levels) + 1)]
        self.caches = [ShardedCache(x.cache_size, x.cache_shards) for x in each]  # of point reads, for each level

    # mutations

    def write(self, key: bytes, value: bytes) -> None:
        """Puts ``value`` under ``key``, whatever was there."""
        self._check_key(key)
        if not value:
            raise EmptyValueError("a value must not be empty")
        if len(value) > self.options.value_max:
            raise ValueTooLargeError(f"a value of {len(value)} bytes; at most {self.options.value_max} are allowed")
        self._stage(bytes(key), bytes(value))

    def delete(self, key: bytes) -> None:
        """Removes ``key``; a key that isn't there may be deleted too."""
        self._check_key(key)
        self._stage(bytes(key), None)

    def apply(self, mutations: DataFrame) -> None:
        """Commits (key, value, seq): a null value deletes, the greatest ``seq`` of a key wins.

        ``seq`` orders the batch within itself; the whole batch is newer than all before it. A
        batch that breaks a rule is refused whole.
        """
        self._check_open()
        o = self.options
        rules = [(EmptyKeyError, F.col("key").isNull() | (F.octet_length("key") == 0)), (KeyTooLargeError, F.octet_length("key") > o.key_max), (EmptyValueError, F.octet_length("value") == 0), (ValueTooLargeError, F.octet_length("value") > o.value_max)]
        counts = mutations.agg(*(F.count(F.when(bad, 1)).alias(str(i)) for i, (_, bad) in enumerate(rules)), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.when(F.col("seq").isNull(), 1)).alias("unordered")).first()
        for i, (error, _) in enumerate(rules):
            if counts[i]:
                raise error(f"{counts[i]} rows of the batch break a rule")
        if counts["unordered"]:
            raise ValueError("every mutation needs a seq")
        if counts["lo"] is None:
            return
        self._raise_failure()
        span = counts["hi"] - counts["lo"] + 1
        with self._commits:
            with self._lock:
                # numbers for the batch: all that is staged by now is older, all that comes later newer
                first, self._next = self._next, self._next + span
                held = self._swap()
            batch = mutations.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), (F.col("seq") - F.lit(counts["lo"]) + F.lit(first)).cast("long").alias("seq"))
            self._publish(batch.unionByName(self._frame(held)) if held else batch, first + span)

    def commit(self) -> bool:
        """Publishes what is staged as a new version; False when nothing is."""
        self._raise_failure()
        with self._commits:
            with self._lock:
                held, upto = self._swap(), self._next
            if not held:
                return False
            self._publish(self._frame(held), upto)
        return True

    def close(self) -> None:
        """Takes no more mutations, and commits those that were taken; closing again does nothing."""
        with self._lock:
            if self._closed:
                return
            self._closed = True
        try:
            self.commit()
        except Exception:
            self._closed = False  # what was staged still is
            raise

    # reads

    def view(self, keep_tombstones: bool = False) -> DataFrame:
        """The newest version of every key, as a DataFrame (key, value, seq)."""
        return merge(self._layers(), keep_tombstones=keep_tombstones)

    def get(self, key: bytes) -> bytes | None:
        """The value under ``key``; None when there is none. Many keys are cheaper by ``multi_get``."""
        if not key:
            raise EmptyKeyError("a key must not be empty")
        key = bytes(key)
        with self._lock:
            for memtable in (self._staged, self._flushing):
                if key in memtable:
                    return memtable[key][0]
            snapshot = self.snapshot

        # levels from the top; of each at most one file has the key in its range, and files never change
        for level, files in enumerate(snapshot.levels):
            for f in files:
                if f.touches(key, key):
                    found = self.caches[min(level, len(self.caches) - 1)].get((f.path, key), lambda path=f.path: self._look_up(path, key))
                    if found is not None:
                        return found or None  # a tombstone is empty
        return None

    def _look_up(self, path: str, key: bytes) -> bytes | None:
        row = get(runs.read(self.spark, [path]), key).first()
        return None if row is None else bytes(row["value"] or b"")

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value, seq) of the keys in column ``key`` that have a value."""
        return multi_get(self._layers(), keys)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Records in order of the key, both ends included; None leaves a side open. Only files that the range touches are opened."""
        return range_scan(merge(self._layers(start, end)), start, end)

    def iterator(self, start: bytes, end: bytes) -> Cursor:
        """A cursor over ``start <= key <= end``; the start must come before the end.

        It reads the version and the staged mutations of this moment, whatever is written later.
        """
        if not start or not end:
            raise EmptyKeyError("a range needs two keys")
        if start >= end:
            raise BadRangeError("the start of a range must come before its end")
        return Cursor(self.scan(bytes(start), bytes(end)).select("key", "value"))

    @property
    def staged_bytes(self) -> int:
        return self._bytes

    def versions(self) -> list[int]:
        return snapshots.versions(self.spark, self.options.path)

    # inside

    def _check_open(self) -> None:
        if self._closed or self._as_of:
            raise ClosedError("the table takes no mutations: it was closed, or opened at an old version")

    def _check_key(self, key: bytes) -> None:
        self._check_open()
        if not key:
            raise EmptyKeyError("a key must not be empty")
        if len(key) > self.options.key_max:
            raise KeyTooLargeError(f"a key of {len(key)} bytes; at most {self.options.key_max} are allowed")

    def _stage(self, key: bytes, value: bytes | None) -> None:
        with self._lock:
            self._check_open()
            old = self._staged.get(key)
            if old is not None:
                self._bytes -= len(key) + len(old[0] or b"")
            self._staged[key] = (value, self._next)
            self._next += 1
            self._bytes += len(key) + len(value or b"")
            if self._bytes > self.options.memtable_size and self._failed is None and (self._flusher is None or not self._flusher.is_alive()):
                self._flusher = threading.Thread(target=self._flush, name="flush", daemon=True)
                self._flusher.start()

    def _flush(self) -> None:
        try:
            self.commit()
        except Exception as e:
            self._failed = e

    def _raise_failure(self) -> None:
        if threading.current_thread() is not self._flusher:
            with self._lock:
                flusher = self._flusher
            if flusher is not None:
                flusher.join()
        failed, self._failed = self._failed, None
        if failed is not None:
            raise failed

    def _swap(self) -> dict[bytes, tuple[bytes | None, int]]:
        """The staged mutations, which are being flushed from now on."""
        self._flushing, self._staged, self._bytes = self._staged, {}, 0
        return self._flushing

    def _frame(self, memtable: dict[bytes, tuple[bytes | None, int]]) -> DataFrame:
        return self.spark.createDataFrame([(k, v, s) for k, (v, s) in memtable.items()], RECORD)

    def _layers(self, start: bytes | None = None, end: bytes | None = None) -> list[DataFrame]:
        """What reads of a range merge, the newest first: both memtables and the levels of one moment."""
        with self._lock:
            memtables, snapshot = [dict(m) for m in (self._staged, self._flushing) if m], self.snapshot
        layers = [self._frame(m) for m in memtables] + [runs.read(self.spark, paths) for i in range(len(snapshot.levels)) if (paths := snapshot.paths(i, start, end))]
        return layers or [runs.read(self.spark, [])]

    def _publish(self, batch: DataFrame, next_seq: int) -> None:
        try:
            new = flush(self.options, self.snapshot, batch, next_seq)
            snapshots.publish(self.spark, self.options.path, new)
            with self._lock:
                self.snapshot, self._flushing = new, {}
        except BaseException:
            with self._lock:
                # staged again, under what was written since
                self._staged, self._flushing = self._flushing | self._staged, {}
                self._bytes = sum(len(k) + len(v or b"") for k, (v, _) in self._staged.items())
            raise
