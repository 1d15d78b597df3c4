"""Substring dedup with fixed-block anchors.

Every document is a reference: its words are cut into blocks of ``BLOCK`` words that don't
overlap, and these are indexed. Every document is also a query: each rolling window of
``BLOCK`` words probes the index. Two documents that share ``2 * BLOCK`` words or more share
a block of either, so no such repeat is missed.

1. *Probe.* Windows and blocks meet by hash. They travel in packed columns (four bytes of
   fingerprint, and byte planes of document numbers that compress to almost nothing), and only
   hits between different documents come back.
2. *Reference.* Around the hits, windows of ``MIN_WORDS`` words are formed; the earliest
   document that holds one is its reference. Linking each document to references instead of to
   every other keeps a passage that many documents share linear. Windows are sent by the least
   hash inside them, so that neighbours arrive together and one link serves a whole stretch.
3. *Extension.* Each linked pair is compared word by word along the link's diagonal, to the
   maximal exact repeat; hashes are checked against the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import cut, few, table, texts

BLOCK, MIN_WORDS = 25, 50
#: Windows that a task holds before it sends them on.
HELD = 2_000_000
#: Bytes of text whose windows fill a bucket, which a task holds whole.
BUCKET_BYTES = 32 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _probes(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Packed windows: (bucket, prints, ids, anchors)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, ids, anchor = (np.concatenate(x) for x in zip(*held))
        rows = [(b, (h[at] & _LOW).astype(np.uint32).tobytes(), V.planes(ids[at]), np.packbits(anchor[at]).tobytes()) for b, at in V.split(V.bucket(h, buckets))]
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "prints", "ids", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in V.slices(batch):
                w = V.Words(part.column(1), fold=False)
                doc = w.doc
                at = np.flatnonzero(V.inside(doc, block))
                d = doc[at]
                held.append((V.window_hash(w.hash, block)[at], part.column(0).to_numpy(zero_copy_only=False)[d], (at - w.first[d]) % block == 0))
                n += len(at)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "bucket int, prints binary, ids binary, anchors binary")


def _hits(table: pa.Table) -> pa.Table:
    """(doc_id, key): windows of one bucket whose print is a block's and occurs in several documents."""
    bucket = table["bucket"][0].as_py()
    prints = np.concatenate([np.frombuffer(x, np.uint32) for x in table["prints"].to_pylist()])
    ids = np.concatenate([V.unplanes(x) for x in table["ids"].to_pylist()])
    anchor = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=len(p) // 4) for a, p in zip(table["anchors"].to_pylist(), table["prints"].to_pylist())])
    order = np.argsort(prints, kind="stable")
    p, d, a = prints[order], ids[order], anchor[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    good = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) & (np.maximum.reduceat(a, first) > 0)
    keep = np.repeat(good, np.diff(np.r_[first, len(p)]))
    pairs = np.unique(np.stack([d[keep], (np.int64(bucket) << 32) | p[keep].astype(np.int64)], 1), axis=0) if keep.any() else np.empty((0, 2), np.int64)
    return pa.table({"doc_id": pa.array(pairs[:, 0]), "key": pa.array(pairs[:, 1])})


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    out, span = h, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def _candidates(rows: DataFrame, block: int, least: int, buckets: int) -> DataFrame:
    """Packed windows of ``least`` words around the hits: (bucket, hashes, ids, places)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, sent, ids, place = (np.concatenate(x) for x in zip(*held))
        out = [(b, h[at].tobytes(), V.planes(ids[at]), V.planes(place[at])) for b, at in V.split(V.bucket(sent, buckets))]
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "hashes", "ids", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in V.slices(batch):
                w = V.Words(part.column(1), fold=False)
                doc, total = w.doc, len(w.hash)
                if total < least:
                    continue
                h = V.window_hash(w.hash, block)
                key = (V.bucket(h, buckets).astype(np.uint64) << np.uint64(32)) | (h & _LOW)
                lists = part.column(2)
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                wanted = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
                tag = lambda k, d: V.mix(k ^ V.mix(d.astype(np.uint64) + np.uint64(1)))
                mark = np.flatnonzero(np.isin(tag(key, doc[: len(h)]), tag(wanted, owner)) & V.inside(doc, block))
                # a window of ``least`` words that holds the block: it begins at most least - block words earlier
                cover = np.zeros(total + 1, np.int32)
                np.add.at(cover, np.maximum(mark - (least - block), w.first[doc[mark]]), 1)
                np.add.at(cover, mark + 1, -1)
                inside = V.inside(doc, least)
                at = np.flatnonzero((np.cumsum(cover)[: len(inside)] > 0) & inside)
                if not len(at):
                    continue
                d = doc[at]
                sent = _sliding_min(h, least - block + 1)[at]
                # the least hash is small by nature: mixed, it spreads over the buckets
                held.append((V.window_hash(w.hash, least)[at], V.mix(sent), part.column(0).to_numpy(zero_copy_only=False)[d], at - w.first[d]))
                n += len(at)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "bucket int, hashes binary, ids binary, places binary")


def _links(least: int):
    def run(table: pa.Table) -> pa.Table:
        """(doc_id, ref_id, shift, at): one link for each stretch of windows with one reference."""
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()])
        ids = np.concatenate([V.unplanes(x) for x in table["ids"].to_pylist()])
        place = np.concatenate([V.unplanes(x) for x in table["places"].to_pylist()])
        order = np.lexsort((place, ids, h))
        h, ids, place = h[order], ids[order], place[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        ref, ref_place = np.repeat(ids[first], size), np.repeat(place[first], size)
        other = ids != ref
        d, r, shift, at = ids[other], ref[other], (place - ref_place)[other], place[other]
        order = np.lexsort((at, shift, r, d))
        d, r, shift, at = d[order], r[order], shift[order], at[order]
        # windows of one diagonal that begin within ``least`` words of each other overlap or touch
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] - at[:-1] > least)
        return pa.table({"doc_id": d[new], "ref_id": r[new], "shift": shift[new], "at": at[new]})

    return run


def repeats_of(a: np.ndarray, b: np.ndarray, shift: np.ndarray, at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words): maximal repeats through the links, none within another."""
    found = []
    order = np.lexsort((at, shift))
    last, falses, lo, hi, done = None, None, 0, 0, -1
    for s, p in zip(shift[order].tolist(), at[order].tolist()):
        if s != last:
            last, lo, hi, done = s, max(0, s), min(len(a), len(b) + s), -1
            falses = np.flatnonzero(a[lo:hi] != b[lo - s : hi - s]) + lo
        if p < done or not lo <= p < hi:
            continue
        j = int(np.searchsorted(falses, p))
        if j < len(falses) and falses[j] == p:
            continue
        start = int(falses[j - 1]) + 1 if j else lo
        done = int(falses[j]) if j < len(falses) else hi
        if done - start >= least:
            found.append((start, start - s, done - start))
    found.sort(key=lambda x: (x[0], -x[2], x[1]))
    out, end = [], -1
    for x in found:
        if x[0] + x[2] > end:
            out.append(x)
            end = x[0] + x[2]
    return out


def _extend(rows: DataFrame, least: int) -> DataFrame:
    names = ["doc_id", "start", "words", "ref_id", "ref_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part = batch.slice(lo, 32)
                a, b = V.Words(part.column(2), fold=False), V.Words(part.column(3), fold=False)
                raw_a, raw_b = a.raw.tobytes(), b.raw.tobytes()
                out = []
                for i, (d, r, links) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(4).to_pylist())):
                    fa, fb = int(a.first[i]), int(b.first[i])
                    shift, at = (np.array([x[k] for x in links], np.int64) for k in ("shift", "at"))
                    for s, t, n in repeats_of(a.hash[fa : a.first[i + 1]], b.hash[fb : b.first[i + 1]], shift, at, least):
                        x = raw_a[a.start[fa + s] : a.end[fa + s + n - 1]].split()
                        if x == raw_b[b.start[fb + t] : b.end[fb + t + n - 1]].split():
                            out.append((d, s, n, r, t))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [()] * 5)], names)

    return rows.mapInArrow(run, "doc_id long, start long, words long, ref_id long, ref_start long")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one of the ids; the ids are broadcast if they are few enough."""
    return docs.join(few(cut(ids.distinct())), "doc_id", "left_semi")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, words, ref_id, ref_start): maximal exact repeats of ``least`` words or more
    between a document and one with a smaller id; words are split at white space, counted from 0.

    Every word of a document that lies in a stretch of ``least`` words which a document with a
    smaller id holds too is in one of its rows: the row of the earliest document that holds that
    stretch. Rows for one pair of documents don't lie within each other. A document's repeats
    of itself don't count. ``least`` is at least ``2 * block - 1``.

    Rows without id or text have no words; where an id occurs more than once, its first text in
    byte order stands for it; texts shorter than ``least`` have no repeats; extra columns are
    ignored; an empty table gives no rows.
    """
    if least < 2 * block - 1:
        raise ValueError("a repeat must be long enough to hold a block whatever its place")
    d = texts(docs, id_col, text_col)
    # as many buckets as the session has partitions, more if the texts are large, so that a bucket's windows have a size
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    hits = _probes(d, block, n).groupBy("bucket").applyInArrow(_hits, "doc_id long, key long")
    keys = cut(hits.groupBy("doc_id").agg(F.collect_list("key").alias("keys")))
    once = lambda x: x.groupBy("doc_id").agg(F.min("text").alias("text"))
    near = once(_of(d, keys.select("doc_id"))).join(keys, "doc_id").select("doc_id", "text", "keys")
    links = _candidates(near, block, least, n).groupBy("bucket").applyInArrow(_links(least), "doc_id long, ref_id long, shift long, at long")
    pairs = cut(links.groupBy("doc_id", "ref_id").agg(F.collect_list(F.struct("shift", "at")).alias("links")))
    both = once(_of(d, pairs.select("doc_id").union(pairs.select("ref_id"))))
    refs = both.select(F.col("doc_id").alias("ref_id"), F.col("text").alias("ref_text"))
    rows = pairs.join(both, "doc_id").join(refs, "ref_id").select("doc_id", "ref_id", "text", "ref_text", "links")
    return _extend(rows, least)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
