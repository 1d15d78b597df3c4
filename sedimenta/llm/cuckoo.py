"""Exact dedup with a cuckoo-filter index over live digests.

The index is split into buckets by digest. A bucket holds a cuckoo filter (16-bit
fingerprints, four to a slot) and the stored keys, digests with the number of live documents under each; the
documents' content lies by bucket in a table beside it. A filter miss proves a digest new, and nothing
else is looked at; a filter hit is verified against content, so a shared fingerprint or digest never makes a
copy. Deleting the last document of a digest removes its fingerprint, so a later insertion of
the same text is new again. An insertion that finds no place after ``MAX_KICKS`` moves doubles
the table and refills it from the stored keys.

Everything is done for arrays of digests at once, and time grows with their number.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import cut, few, texts, unused

SLOT, MAX_KICKS = 4, 200
#: Buckets of one pass of dedup, whatever the number of tasks: a task holds the filter of one of them at a time.
BUCKETS = 1 << 16


class CuckooFilter:
    """Approximate set of 64-bit digests with deletion; never forgets a digest it holds."""

    def __init__(self, slots: int = 64):
        self.slots = 1 << max(1, (slots - 1).bit_length())
        self.table = np.zeros((self.slots, SLOT), np.uint16)  # 0: a free place
        self.size = 0

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = V.mix(digests.view(np.uint64))
        fp = np.maximum(h >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        a = (h & np.uint64(self.slots - 1)).astype(np.int64)
        return fp, a, self._other(fp, a)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ (V.mix(fp.astype(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        """Whether each digest may be in the set; False is certain."""
        fp, a, b = self._places(digests)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def _settle(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free places of their slots; the places in the arrays of those left over."""
        order = np.argsort(at, kind="stable")
        slot = at[order]
        head = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(slot)])
        nth = np.arange(len(slot)) - np.repeat(head, np.diff(np.r_[head, len(slot)]))
        free = self.table[slot] == 0
        fits = nth < free.sum(1)
        # the nth free place of the slot
        which = np.argmax(np.cumsum(free, 1) == (nth + 1)[:, None], 1)
        self.table[slot[fits], which[fits]] = fp[order[fits]]
        self.size += int(fits.sum())
        return order[~fits]

    def add(self, digests: np.ndarray) -> bool:
        """False when no place was found for some of them; the set must be filled anew then."""
        fp, at, b = self._places(digests)
        left = self._settle(fp, at)
        fp, at = fp[left], b[left]
        for kick in range(MAX_KICKS):
            left = self._settle(fp, at)
            fp, at = fp[left], at[left]
            if not len(fp):
                return True
            # one fingerprint of each full slot takes another's place, which goes to its other slot
            slot, first = np.unique(at, return_index=True)
            out = self.table[slot, kick % SLOT].copy()
            self.table[slot, kick % SLOT] = fp[first]
            fp[first], at[first] = out, self._other(out, slot)
        return False

    def discard(self, digests: np.ndarray) -> None:
        """Removes one occurrence of each; only digests that were added may be removed."""
        fp, a, b = self._places(digests)
        for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist()):
            for at in (x, y):
                found = np.flatnonzero(self.table[at] == f)
                if len(found):
                    self.table[at, found[0]] = 0
                    self.size -= 1
                    break


class CuckooIndex:
    """Live digests of one bucket: the filter, and the keys it can be rebuilt from."""

    def __init__(self, slots: int = 64):
        self.filter = CuckooFilter(slots)
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)  # in order of the key
        self.resizes = 0

    def insert(self, digests: np.ndarray) -> np.ndarray:
        """Adds a live document for each; returns the digests that the filter holds already or that occur twice here."""
        kinds, n = np.unique(digests, return_counts=True)
        maybe = self.filter.contains(kinds)
        hits = kinds[maybe | (n > 1)]
        # what the filter has never seen is new; the rest is looked up in the stored keys
        at = np.searchsorted(self.keys, kinds[maybe])
        there = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == kinds[maybe]) if len(self.keys) else np.zeros(len(at), bool)
        self.counts[at[there]] += n[maybe][there]
        new = ~maybe
        new[np.flatnonzero(maybe)[~there]] = True
        fresh = kinds[new]
        if len(fresh):
            at = np.searchsorted(self.keys, fresh)
            self.keys, self.counts = np.insert(self.keys, at, fresh), np.insert(self.counts, at, n[new])
            if not self.filter.add(fresh):
                self._resize()
        return hits

    def delete(self, digests: np.ndarray) -> int:
        """Removes a live document for each; those that aren't live are passed over. The number removed."""
        kinds, n = np.unique(digests, return_counts=True)
        maybe = self.filter.contains(kinds)
        kinds, n = kinds[maybe], n[maybe]
        at = np.searchsorted(self.keys, kinds)
        there = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == kinds)) if len(self.keys) else []
        at, n = at[there], n[there]
        gone = np.minimum(n, self.counts[at])
        self.counts[at] -= gone
        dead = self.counts == 0
        if dead.any():
            self.filter.discard(self.keys[dead])
            self.keys, self.counts = self.keys[~dead], self.counts[~dead]
        return int(gone.sum())

    def _resize(self) -> None:
        """Twice the slots, refilled from the stored keys; again until all fit."""
        slots = self.filter.slots
        while True:
            slots *= 2
            self.resizes += 1
            self.filter = CuckooFilter(slots)
            if self.filter.add(self.keys):
                return

    def dumps(self) -> bytes:
        return pickle.dumps((self.filter.table, self.filter.size, self.keys, self.counts, self.resizes))

    @classmethod
    def loads(cls, raw: bytes) -> CuckooIndex:
        out = cls()
        table, size, out.keys, out.counts, out.resizes = pickle.loads(raw)
        out.filter.table, out.filter.size, out.filter.slots = table, size, len(table)
        return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, digest) of rows that have both an id and a text."""
    return texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")


class Index(NamedTuple):
    """A stored index: (bucket, state, live, digests, resizes) and the live documents (bucket, digest, doc_id, text)."""

    filters: DataFrame
    content: DataFrame


def apply_changes(index: Index | None, inserts: DataFrame | None, deletes: DataFrame | None = None, buckets: int = 64) -> Index:
    """The index after deletions, then insertions, of documents (doc_id, text).

    A deletion takes every live row with that id and text; one that names none changes nothing. Rows
    without id or text are ignored. ``index`` is None for a new one. The number of buckets must stay the same over an index's life.
    """
    some = index.filters if index is not None else inserts if inserts is not None else deletes
    if some is None:
        raise ValueError("nothing to build an index from")
    spark = some.sparkSession
    none = spark.createDataFrame([], "doc_id long, text string")
    new = digests(inserts if inserts is not None else none).select(_bucket(buckets), "digest", "doc_id", "text")
    old = index.content if index is not None else new.limit(0)
    gone = digests(deletes if deletes is not None else none).select("digest", "doc_id", "text").distinct()
    on = ["digest", "doc_id", "text"]
    removed = old.join(gone, on, "left_semi")
    rows = removed.select("bucket", "digest", F.lit(0).alias("kind")).unionByName(new.select("bucket", "digest", F.lit(1).alias("kind")))
    states = index.filters.select("bucket", "state") if index is not None else spark.createDataFrame([], "bucket int, state binary")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ix = CuckooIndex.loads(left["state"].iloc[0]) if len(left) else CuckooIndex()
        kind, digest = right["kind"].to_numpy(), right["digest"].to_numpy(np.int64)
        ix.delete(digest[kind == 0])
        ix.insert(digest[kind == 1])
        return pd.DataFrame({"bucket": [key[0]], "state": [ix.dumps()], "live": [int(ix.counts.sum())], "digests": [len(ix.keys)], "resizes": [ix.resizes]})

    filters = states.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(run, "bucket int, state binary, live long, digests long, resizes long")
    return Index(cut(filters), cut(old.join(gone, on, "left_anti").select("bucket", *on).unionByName(new)))


def probe(index: Index, docs: DataFrame, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id): documents whose text is live in the index, with the least live id that has it.

    Filter hits are verified against the content of their bucket. Rows without id or text have none; repeated rows give one.
    """
    d = digests(docs, id_col, text_col)
    rows = d.select(_bucket(buckets), "digest")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = np.unique(right["digest"].to_numpy(np.int64))
        if len(left) and len(found):
            found = found[CuckooIndex.loads(left["state"].iloc[0]).filter.contains(found)]
        return pd.DataFrame({"digest": found if len(left) else found[:0]})

    maybe = index.filters.select("bucket", "state").groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(run, "digest long")
    live = index.content.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"))
    return d.join(maybe, "digest", "left_semi").join(live, ["digest", "text"]).select("doc_id", "keep_id").distinct()


def _hits(rows: DataFrame) -> DataFrame:
    """(digest): digests that their bucket's filter held when they came, from rows (bucket, digest) in order of the bucket."""

    @V.tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, at = CuckooIndex(), None
        for batch in batches:
            bucket, digest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            hits = [np.empty(0, np.int64)]
            for b, here in V.split(bucket):
                if b != at:
                    ix, at = CuckooIndex(), b
                hits.append(ix.insert(digest[here]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hits))], ["digest"])

    return rows.mapInArrow(run, "digest long")


def _copies(d: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, digest, text, keep_id) of the copies, (doc_id, digest, text) of rows that are there more than once), from digests.

    ``text`` is null, unless different texts have that digest.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = d.select(_bucket(buckets), "digest").repartition(n, "bucket").sortWithinPartitions("bucket")
    wanted = cut(_hits(rows).distinct())
    same = d.join(few(wanted), "digest", "left_semi")
    # all texts under one digest are equal when the least and the greatest are; map tasks combine copies
    groups = cut(same.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keep_id", (F.col("lo") != F.col("hi")).alias("mixed")))
    ids = cut(same.groupBy("digest", "doc_id").count())
    plain = ids.join(few(groups.where("not mixed")), "digest")
    text = F.lit(None).cast("string").alias("text")
    copies = plain.where("doc_id <> keep_id").select("doc_id", "digest", text, "keep_id")
    again = plain.where("count > 1").select("doc_id", "digest", text)
    if groups.where("mixed").isEmpty():
        return copies, again
    # different texts with one digest: told apart by the texts themselves
    apart = same.join(few(groups.where("mixed")).select("digest"), "digest", "left_semi").groupBy("digest", "doc_id", "text").count()
    least = apart.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"))
    apart = cut(apart.join(least, ["digest", "text"]))
    return copies.unionByName(apart.where("doc_id <> keep_id").select("doc_id", "digest", "text", "keep_id")), again.unionByName(apart.where("count > 1").select("doc_id", "digest", "text"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, keep_id): every document whose text equals that of a document with a smaller
    id, and the least such id. Texts are equal when they are so byte by byte.

    Rows without id or text are no copies and have none. Empty texts are copies of each other; so are very long ones that are equal.
    A repeated row (same id, same text) has no row of its own and the result names an id once
    for each text that it has. Extra columns are ignored; an empty table gives no rows.
    """
    return _copies(digests(docs, id_col, text_col), buckets)[0].select("doc_id", "keep_id")


def stage_exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id stays; rows without id or text all stay.

    A repeated row stays once. Where one id has several texts, each is judged by its own text. An empty table
    stays empty; the columns are those of ``docs``, whatever their names.
    """
    copies, again = _copies(digests(docs), BUCKETS)
    own = unused(docs, "digest")
    rows = docs.withColumn(own, F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["text"])))
    here = lambda x: (rows["doc_id"] == x["i"]) & (rows[own] == x["d"]) & (x["t"].isNull() | (rows["text"] == x["t"]))
    named = lambda x: few(cut(x.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("i"), F.col("digest").alias("d"), F.col("text").alias("t"))))
    gone, again = named(copies), named(again)
    left = rows.join(gone, here(gone), "left_anti")
    if not again.isEmpty():
        once = rows.join(again, here(again), "left_semi").join(gone, here(gone), "left_anti").dropDuplicates(["doc_id", own, "text"])
        left = left.join(again, here(again), "left_anti").union(once)
    return left.select(docs.columns)


ORACLE_SQL = """
SELECT doc_id, keep_id FROM (
  SELECT DISTINCT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> keep_id
"""


def exact_index(spark, docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id) of all documents probed against an index of them from which every third id was deleted and some came back."""
    mod = F.pmod("doc_id", F.lit(9))
    ix = apply_changes(None, docs)
    ix = apply_changes(ix, docs.where(mod == 6), docs.where(F.pmod("doc_id", F.lit(3)) == 0))
    return probe(ix, docs)


INDEX_SQL = """
SELECT DISTINCT d.doc_id, live.keep_id FROM documents d JOIN (
  SELECT text, min(doc_id) AS keep_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 9 = 6 GROUP BY text) live ON d.text = live.text
WHERE d.doc_id IS NOT NULL
"""
