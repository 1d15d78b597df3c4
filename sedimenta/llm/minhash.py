"""MinHash near-dedup by a signature-coordinate inverted join.

1. *Signatures.* Every text gets ``K`` coordinates: the least hash of its word shingles
   under ``K`` functions. Texts with equal signatures collapse to one representative, so
   thousands of plain copies cost one posting list entry.
2. *Postings.* A representative is posted under each (coordinate, value) pair; the size of
   a posting list is the frequency of the pair over the whole corpus.
3. *Prefix.* Two signatures that agree on at least ``t`` of ``K`` pairs share one pair within
   the ``K - t + 1`` rarest pairs of either, in one global order (frequency, then pair). Only
   those prefixes are joined. Pairs that occur once take up prefix places but join with
   nothing, so a text without near copies seldom reaches the join at all.
4. *Skip merge.* Candidates from the short lists are not merged through the long ones: the
   collisions on the remaining coordinates are counted by probing. At first a posting carries a
   sketch, two bits of each value: two equal values have equal bits, so members of a list that
   share too few bits with every other can be dropped without loss. What is left is compared by
   whole signatures.
5. A posting list links its members to a few leaders instead of all to all. Links are
   only made at or above the threshold, and two members stay apart only after every pair
   across their groups has been compared, so the groups equal those of all pairs above the
   threshold. No list is cut short.

Groups are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V
from .common import cut, texts, without

#: Coordinates of a signature, words of a shingle, and coordinates that must collide.
K, SHINGLE, THRESHOLD = 64, 2, 28
#: Representatives for each bucket of postings.
PER_BUCKET = 50_000

_MULT = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.uint64((1 << 64) - 1)


def signature_matrix(col: pa.Array, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    """``len(col) x k`` uint32 signatures.

    A text shorter than a shingle is one shingle; a text without words gets the
    signature of nothing (all ones), so texts without words are copies of each other.
    """
    w = V.Words(col)
    n = np.diff(w.first)
    h, doc = w.hash, w.doc
    values, first = h, w.first
    if shingle > 1 and len(h):
        rolled = V.window_hash(h, shingle)
        ok = V.inside(doc, shingle)
        # texts of fewer words than a shingle: their words' hash as one range
        short = np.flatnonzero((n > 0) & (n < shingle))
        extra = np.zeros(len(short), np.uint64)
        for j in range(shingle - 1):
            at = w.first[short] + j
            has = j < n[short]
            extra[has] = V.mix(extra[has] * np.uint64(31) + h[at[has]] + np.uint64(1))
        owner = np.concatenate([doc[: len(rolled)][ok], short])
        values = np.concatenate([rolled[ok], extra])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
        first = np.searchsorted(owner, np.arange(len(n) + 1))
    out = np.full((len(n), k), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        at = first[:-1][filled]
        for i in range(k):
            v = values * _MULT[i]
            v ^= v >> np.uint64(31)
            v *= _MULT[255 - i]
            out[filled, i] = np.minimum.reduceat(v, at) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig binary of ``4 k`` bytes); ``docs`` holds doc_id and text."""

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch):
                m = signature_matrix(part.column(1), k, shingle)
                sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * k), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))])
                yield pa.RecordBatch.from_arrays([part.column(0), sig.cast(pa.binary())], ["doc_id", "sig"])

    return docs.mapInArrow(run, "doc_id long, sig binary")


def _matrix(col: pa.Array, k: int) -> np.ndarray:
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(-1, k)


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate as ``n x 2k`` packed bits: all first bits, then all second ones."""
    return np.concatenate([np.packbits(sig & 1, axis=1), np.packbits(sig >> 1 & 1, axis=1)], axis=1)


def sketch_matches(sketch: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Coordinates on which both bits are equal: never fewer than the values that are."""
    x = sketch ^ other
    half = x.shape[1] // 2
    return k - np.bitwise_count(x[:, :half] | x[:, half:]).sum(1, dtype=np.int64)


def _sketches(reps: DataFrame, k: int) -> DataFrame:
    """(rep, sketch)."""

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sketch_of(_matrix(batch.column(1), k))], pa.binary())], ["rep", "sketch"])

    return reps.mapInArrow(run, "rep long, sketch binary")


def _parts(reps: DataFrame) -> int:
    """Buckets of postings: as the session has it, more if the representatives are many, so that a task's share has a size."""
    return max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-reps.count() // PER_BUCKET))


def _shared_pairs(reps: DataFrame, k: int) -> DataFrame:
    """(rep, rank): the pairs of each signature that another signature has too.

    ``rank`` holds the frequency above the pair, so that sorting by it is the global order; a
    frequency beyond ``2**25`` counts as that. Pairs are shuffled in columns, packed by bucket.
    """
    buckets = _parts(reps)

    @V.tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                m = _matrix(part.column(1), k)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(rep, kind="stable")
                rep, m = rep[order], m[order]
                rows = []
                for i in range(k):
                    bucket = (V.mix(m[:, i].astype(np.uint64) + np.uint64(i << 32)) % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(cuts)):
                        x = by[cuts[b] : cuts[b + 1]]
                        rows.append((int(b), i, m[x, i].tobytes(), V.planes(rep[x])))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "coord", "value", "rep"])

    def shared(t: pa.Table) -> pa.Table:
        coord = t["coord"].to_numpy()
        value = [np.frombuffer(x, np.uint32) for x in t["value"].to_pylist()]
        rep = np.concatenate([V.unplanes(x) for x in t["rep"].to_pylist()])
        pair = np.repeat(coord.astype(np.int64) << 32, [len(v) for v in value]) | np.concatenate(value).astype(np.int64)
        _, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
        freq = n[inverse]
        keep = freq > 1
        return pa.table({"rep": rep[keep], "rank": (np.minimum(freq[keep], (1 << 25) - 1) << 38) | pair[keep]})

    return reps.mapInArrow(pack, "bucket int, coord int, value binary, rep binary").groupBy("bucket").applyInArrow(shared, "rep long, rank long")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """(pair, rep, payload, cuts) of whole posting lists from rows that lie in order of the pair."""
    held: list[pa.RecordBatch] = []  # the list that isn't over yet

    def whole(parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts)
        pair = t.column(0).to_numpy()
        return pair, t.column(1).to_numpy(), t.column(2).to_pylist(), np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True])

    for batch in batches:
        if not batch.num_rows:
            continue
        pair = batch.column(0).to_numpy()
        last = int(np.searchsorted(pair, pair[-1]))
        if held and (last or held[0].column(0)[0].as_py() != pair[0]):
            yield whole([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield whole([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield whole(held)


def _prune(rows: DataFrame, k: int, t: int) -> DataFrame:
    """(pair, rep): members that may match another of their list, from rows (pair, rep, sketch)."""

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, rep, payload, cuts in _lists(batches):
            sk = np.frombuffer(b"".join(payload), np.uint8).reshape(len(pair), -1)
            keep = np.zeros(len(pair), bool)
            two = cuts[:-1][np.diff(cuts) == 2]
            good = two[sketch_matches(sk[two], sk[two + 1], k) >= t]
            keep[good] = keep[good + 1] = True
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 3:
                    continue
                part, found = sk[lo:hi], keep[lo:hi]
                for a in range(hi - lo):
                    if not found[a]:
                        near = sketch_matches(part, part[a : a + 1], k) >= t
                        if near.sum() > 1:  # itself and another
                            found |= near
            yield pa.RecordBatch.from_arrays([pa.array(pair[keep]), pa.array(rep[keep])], ["pair", "rep"])

    return rows.mapInArrow(run, "pair long, rep long")


def link_members(sig: np.ndarray, t: int) -> list[tuple[int, int, int]]:
    """Links (a, b, matches), each of at least ``t`` matches, whose groups are those of all
    pairs with at least ``t`` matches.

    A leader is compared with every member; what it matches needs no leader of its own. What
    is left apart after that is compared in full, group against group, until linked.
    """
    n = len(sig)
    group = np.arange(n)
    led = np.zeros(n, bool)
    links: list[tuple[int, int, int]] = []

    def join(a: int, b: int, m: int) -> None:
        links.append((a, b, m))
        ga, gb = group[a], group[b]
        if ga != gb:
            group[group == max(ga, gb)] = min(ga, gb)

    for a in range(n):
        if led[a]:
            continue
        led[a] = True
        same = (sig == sig[a]).sum(1)
        for b in np.flatnonzero(same >= t):
            if b != a:
                led[b] = True
                if group[a] != group[b]:
                    join(a, int(b), int(same[b]))
    names, counts = np.unique(group, return_counts=True)
    # members of the smaller groups, as they are now, against all that are outside their own by then
    for members in [np.flatnonzero(group == g) for g in names[np.argsort(counts, kind="stable")][:-1]]:
        for a in members:
            out = np.flatnonzero(group != group[a])
            if not len(out):
                break
            same = (sig[out] == sig[a]).sum(1)
            for b, m in zip(out[same >= t], same[same >= t]):
                if group[a] != group[b]:
                    join(int(a), int(b), int(m))
    return links


def _links_in_postings(rows: DataFrame, k: int, t: int) -> DataFrame:
    """(a, b, matches) from rows (pair, rep, sig) that lie together by pair, in its order."""

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rep, payload, cuts in _lists(batches):
            sig = np.frombuffer(b"".join(payload), np.uint32).reshape(-1, k)
            found = [(int(rep[lo + x]), int(rep[lo + y]), m) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi - lo > 1 for x, y, m in link_members(sig[lo:hi], t)]
            a, b, m = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int32())], ["a", "b", "matches"])

    return rows.mapInArrow(run, "a long, b long, matches int")


def near_links(sigs: DataFrame, k: int = K, t: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """((doc_id, rep) of texts with an equal signature, (a, b, matches) between representatives)."""
    reps = cut(sigs.groupBy("sig").agg(F.min("doc_id").alias("rep")).select("rep", "sig"))
    same = sigs.join(reps, "sig").where("doc_id <> rep").select("doc_id", "rep")
    # the prefix: k - t + 1 rarest pairs, of which k - size(ranks) occur once
    ranks = _shared_pairs(reps, k).groupBy("rep").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    prefix = ranks.where(F.size("ranks") >= t).select("rep", F.slice("ranks", F.lit(1), F.size("ranks") - F.lit(t - 1)).alias("prefix"))
    n = _parts(reps)
    posted = prefix.join(_sketches(reps, k), "rep").select(F.explode("prefix").alias("rank"), "rep", "sketch")
    pair = F.col("rank").bitwiseAND(F.lit((1 << 38) - 1)).alias("pair")
    maybe = cut(_prune(posted.select(pair, "rep", "sketch").repartition(n, "pair").sortWithinPartitions("pair", "rep"), k, t))
    joined = maybe.join(reps, "rep").select("pair", "rep", "sig").repartition(n, "pair").sortWithinPartitions("pair", "rep")
    links = _links_in_postings(joined, k, t)
    return same, links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("matches").alias("matches"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, matches): all pairs of documents, ``a < b``, of which at least ``threshold`` coordinates collide.

    Collisions are counted by a merge of the postings of the prefixes. A pair whose count, with all coordinates that
    its prefixes leave out, can't reach the threshold is skipped; for the others the remaining, longer lists are probed in the
    signatures. Documents with equal signatures are a pair each with each: a result that grows with the square of a group, which ``near_duplicates`` avoids.
    Odd rows are treated as there.
    """
    sigs = cut(signatures(texts(docs, id_col, text_col), k, shingle).groupBy("doc_id").agg(F.min("sig").alias("sig")))
    reps = cut(sigs.groupBy("sig").agg(F.min("doc_id").alias("rep")).select("rep", "sig"))
    ranks = _shared_pairs(reps, k).groupBy("rep").agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    prefix = cut(ranks.where(F.size("ranks") >= threshold).select("rep", F.slice("ranks", F.lit(1), F.size("ranks") - F.lit(threshold - 1)).alias("prefix")))
    left_out = F.greatest(F.lit(k) - F.size("prefix"), F.lit(0))
    posted = prefix.select("rep", left_out.alias("rest"), F.explode("prefix").alias("rank"))
    x, y = posted.select("rank", F.col("rep").alias("a"), F.col("rest").alias("ra")), posted.select("rank", F.col("rep").alias("b"), F.col("rest").alias("rb"))
    merged = x.join(y, "rank").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    maybe = merged.where(F.col("n") + F.greatest("ra", "rb") >= threshold).select("a", "b")
    both = maybe.join(reps.withColumnsRenamed({"rep": "a", "sig": "sa"}), "a").join(reps.withColumnsRenamed({"rep": "b", "sig": "sb"}), "b")

    @V.tidy
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (_matrix(batch.column(2), k) == _matrix(batch.column(3), k)).sum(1).astype(np.int32)
            keep = pa.array(n >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["a", "b", "matches"]).filter(keep)

    links = both.select("a", "b", "sa", "sb").mapInArrow(probe, "a long, b long, matches int")
    # documents for their representatives
    of = sigs.join(reps, "sig").select("doc_id", "rep")
    apart = links.join(of.withColumnsRenamed({"doc_id": "x", "rep": "a"}), "a").join(of.withColumnsRenamed({"doc_id": "y", "rep": "b"}), "b").select("x", "y", "matches")
    same = of.withColumnRenamed("doc_id", "x").join(of.withColumnRenamed("doc_id", "y"), "rep").where("x < y").select("x", "y", F.lit(k).alias("matches"))
    return apart.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "matches")


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of links (a, b); root is the least node.

    Each round every node takes the least root among its neighbours, then the root of its
    root; links within one group drop out, so a round handles only what is still open.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    root = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while True:
        # edges between roots
        e = edges.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(e.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return root
        # b hooks onto its least neighbour; a chain of hooks is followed by doubling
        hook = cut(edges.groupBy("b").agg(F.min("a").alias("to")))
        while True:
            up = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.b"), "left")
            nxt = cut(up.select(F.col("x.b").alias("b"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")))
            hook = nxt.select("b", "to")
            if nxt.where("moved").isEmpty():
                break
        root = cut(root.join(hook, root["root"] == hook["b"], "left").select("node", F.coalesce("to", "root").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, keep_id): every document that has a near copy with a smaller id in its group,
    and the least id of that group. A document alone, or the least of its group, has no row.

    Two texts are near copies when at least ``threshold`` of ``k`` coordinates collide;
    a group holds what such pairs connect. Letter case and ASCII punctuation don't count.
    Rows without id or text have no row and belong to no group; texts without words are
    copies of each other; a repeated row is its own copy and yields nothing; an empty table
    gives an empty result. Extra columns are ignored; texts may be of any length; what isn't UTF-8 counts as U+FFFD.
    """
    sigs = cut(signatures(texts(docs, id_col, text_col), k, shingle))
    same, links = near_links(sigs, k, threshold)
    root = components(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(links.select("a", "b")))
    return root.where("node <> root").select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id, with every row of that id.

    Rows without id or text stay; texts without words are one group; an empty table stays empty. The columns are those of ``docs``, whatever their names.
    """
    return without(docs, cut(near_duplicates(docs)))
