"""Benchmark decontamination with spaced seeds.

A mask of fixed shape selects some of the words of a window and ignores the others, so a
window whose ignored words were replaced still has the same hash. Every window of every
document is hashed under every mask and joined with the windows of the benchmark; each hit
gives a diagonal, on which document and item are compared word by word. The best stretch of
the diagonal (matches weighed against substitutions) is reported, or if it is too loose or
short, another one that isn't.

Long masks don't fit into short items, so items of fewer than ``SHORT`` words have masks of three words. Every
placement of the substitutions that the rule allows in them leaves one of these masks intact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import vectext as V
from .common import cut, table, texts, without

#: Words that count (1) and words that are ignored (0): for long items, and for those of fewer than SHORT words.
MASKS = ("11011011011", "1110010111", "1101001010111", "111111")
SHORT_MASKS, SHORT = ("111", "1101", "1011"), 16
#: A stretch needs this many equal words, or this share of the words of an item if that is less, and this share of equal words.
MIN_MATCH, MIN_SHARE = 12, 0.75
#: Items of fewer words tolerate no substitution; those of fewer than WHOLE words must be all that a document says.
STRICT, WHOLE = 6, 3
#: Seed hits, and cells of the comparison, that are held at once.
HITS, CELLS = 1 << 20, 1 << 22
#: Weight of a substitution against a match of 1 while the best stretch is sought.
SUBSTITUTION = 1.5
#: Benchmark words that are handled in one pass over the documents; more take further passes.
PASS_WORDS = 2_000_000
_BITS = 22


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of ``len(mask)`` words under the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += h[j : j + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (1 << 64) - 1 | 1)
    return V.mix(out)


def least_matches(length: np.ndarray, min_match: int, min_share: float) -> np.ndarray:
    """Equal words that a stretch of an item needs, by the item's words."""
    share = np.ceil(min_share * length - 1e-9).astype(np.int64)
    return np.minimum(min_match, np.where(length < STRICT, length, share))


class Benchmark:
    """Words and sorted seed hashes of a block of benchmark items."""

    def __init__(self, ids: list[int], text: list[str], masks: tuple[str, ...] = MASKS):
        w = V.Words(pa.array(text, pa.large_string()))
        self.ids, self.first, self.hash = np.array(ids, np.int64), w.first, w.hash
        self.seeds = []
        doc, length = w.doc, np.diff(w.first)
        self.whole = np.flatnonzero((length > 0) & (length < WHOLE))
        for mask in masks + SHORT_MASKS:
            s = seed_hashes(w.hash, mask)
            kind = (length[doc] < SHORT) == (mask in SHORT_MASKS)
            at = np.flatnonzero(V.inside(doc, len(mask)) & kind[: len(s)])
            order = np.argsort(s[at], kind="stable")
            self.seeds.append((mask, s[at][order], at[order]))
        self._mark()

    def _mark(self) -> None:
        self.seen = []
        for _, s, _ in self.seeds:
            seen = np.zeros(1 << _BITS if len(s) else 1, bool)
            seen[(s >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.seen.append(seen)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._mark()

    def overlaps(self, col: pa.Array, min_match: int, min_share: float) -> dict[str, np.ndarray]:
        """Verified stretches of the texts of ``col``: text, item, start, words, matches."""
        w = V.Words(col)
        doc = w.doc
        item_of = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        diag = [np.empty((0, 3), np.int64)]
        for (mask, s, at), seen in zip(self.seeds, self.seen):
            h = seed_hashes(w.hash, mask)
            if not len(h) or not len(s):
                continue
            p = np.flatnonzero(seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(s, h[p], "left"), np.searchsorted(s, h[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ok = doc[p] == doc[np.minimum(p + len(mask) - 1, len(doc) - 1)]
            p, lo, n = p[ok], lo[ok], n[ok]
            for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1):
                q, k = np.repeat(p[part], n[part]), n[part]
                b = at[np.repeat(lo[part], k) + np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)]
                item = item_of[b]
                diag.append(np.unique(np.stack([doc[q], item, q - (b - self.first[item])], 1), axis=0))
        # items of a word or two: only where a document says nothing else
        size = np.diff(w.first)
        for i in self.whole.tolist():
            own = self.hash[self.first[i] : self.first[i + 1]]
            t = np.flatnonzero(size == len(own))
            for j, x in enumerate(own):
                t = t[w.hash[w.first[t] + j] == x]
            diag.append(np.stack([t, np.full(len(t), i), w.first[t]], 1))
        d = np.unique(np.concatenate(diag), axis=0)
        # long items last, so that what is compared side by side is of like width
        length = np.diff(self.first)[d[:, 1]]
        d, width = d[np.argsort(length, kind="stable")], np.sort(length)
        found, at = [self._stretch(w, d[:0], min_match, min_share)], 0
        while at < len(d):
            to = at + 1
            while to < len(d) and (to - at + 1) * (width[to] + 1) <= CELLS and to - at < 4096:
                to += 1
            found.append(self._stretch(w, d[at:to], min_match, min_share))
            at = to
        cols = [np.concatenate(x) for x in zip(*found)]
        return dict(zip(("text", "item", "start", "words", "matches"), cols))

    def _stretch(self, w: V.Words, d: np.ndarray, min_match: int, min_share: float) -> tuple[np.ndarray, ...]:
        """Best stretch of each diagonal (text, item, word of the document under the item's first); where that
        doesn't satisfy the rule, the one with most equal words of all that do."""
        n = len(d)
        length = np.diff(self.first)[d[:, 1]] if n else np.empty(0, np.int64)
        lo, hi = w.first[d[:, 0]], w.first[d[:, 0] + 1]
        best, best_from, best_to = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        run, run_from = np.zeros(n), np.zeros(n, np.int64)
        width = int(length.max()) if n else 0
        equal = np.zeros((n, width + 1), np.int32)  # running count of equal words
        for j in range(width):
            at = d[:, 2] + j
            ok = (j < length) & (at >= lo) & (at < hi)
            same = ok & (w.hash[np.clip(at, 0, len(w.hash) - 1)] == self.hash[np.clip(self.first[d[:, 1]] + j, 0, len(self.hash) - 1)])
            equal[:, j + 1] = equal[:, j] + same
            fresh = run <= 0
            run = np.where(ok, np.where(fresh, 0, run) + np.where(same, 1, -SUBSTITUTION), 0)
            run_from = np.where(fresh, j, run_from)
            more = run > best
            best, best_from, best_to = np.where(more, run, best), np.where(more, run_from, best_from), np.where(more, j + 1, best_to)
        rows = np.arange(n)
        matches = equal[rows, best_to] - equal[rows, best_from]
        words = best_to - best_from
        least = least_matches(length, min_match, min_share)
        good = (matches >= least) & (matches >= min_share * words) & (words > 0)
        for k in np.flatnonzero(~good & (equal[:, -1] >= least) & (least > 0)):
            a, z = max(0, lo[k] - d[k, 2]), min(length[k], hi[k] - d[k, 2])
            if (cut := _any_stretch(equal[k, a : z + 1], int(least[k]), min_share)) is not None:
                best_from[k], best_to[k] = a + cut[0], a + cut[1]
                words[k], matches[k], good[k] = cut[1] - cut[0], equal[k, best_to[k]] - equal[k, best_from[k]], True
        return d[good, 0], d[good, 1], (d[:, 2] + best_from - lo)[good], words[good], matches[good].astype(np.int64)


def _any_stretch(equal: np.ndarray, least: int, share: float) -> tuple[int, int] | None:
    """(from, to) of the stretch with most equal words among all that have ``least`` of them and that
    share, without unequal words at its ends; ``equal`` is the running count of equal words."""
    over = equal - share * np.arange(len(equal))
    low = np.minimum.accumulate(over)
    # a stretch has the share if it starts where ``over`` is no higher than at its end
    start = np.searchsorted(-low, -(over + 1e-9))
    matches = equal - equal[np.minimum(start, len(equal) - 1)]
    ends = np.flatnonzero((start < np.arange(len(equal))) & (matches >= least))
    if not len(ends):
        return None
    to = ends[np.argmax(matches[ends])]
    return int(np.searchsorted(equal, equal[start[to]], "right")) - 1, int(np.searchsorted(equal, equal[to]))


def _blocks(bench: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of at most ``PASS_WORDS`` words, so that what a pass holds is bounded."""
    ids: list[int] = []
    text: list[str] = []
    n = 0
    for row in texts(bench, id_col, text_col).orderBy("doc_id", "text").toLocalIterator():
        size = len(row.text) // 2 + 1
        if ids and n + size > PASS_WORDS:
            yield ids, text
            ids, text, n = [], [], 0
        ids.append(row.doc_id)
        text.append(row.text)
        n += size
    if ids:
        yield ids, text


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, item_id, start, words, matches): for each document and item a stretch
    on each diagonal with a seed that has one, which holds ``min_match`` equal words (or ``min_share`` of the words of a shorter item) and at
    least ``min_share`` equal words; ``start`` counts the document's words from 0.

    Letter case and ASCII punctuation don't count. An item of fewer than ``STRICT`` words must be there without
    substitution, and one of fewer than ``WHOLE`` words must be all the words of a document; one without words is never
    found. Rows without id or text are ignored on both sides, as are extra columns; texts may be empty or of any
    length; what isn't UTF-8 counts as U+FFFD. Repeated rows give one row; an empty table on either side gives none. A
    benchmark that is larger than one pass holds takes several passes over the documents, each written before the next.
    """
    names, spark = ["doc_id", "item_id", "start", "words", "matches"], docs.sparkSession
    schema = ", ".join(f"{x} long" for x in names)
    d = texts(docs, id_col, text_col)

    def search(ids: list[int], text: list[str]) -> tuple[DataFrame, Broadcast]:
        shipped = spark.sparkContext.broadcast(Benchmark(ids, text))  # at most PASS_WORDS words, or one item

        @V.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shipped.value
            for batch in batches:
                for part in V.slices(batch):
                    f = b.overlaps(part.column(1), min_match, min_share)
                    doc = part.column(0).to_numpy(zero_copy_only=False)[f["text"]]
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(b.ids[f["item"]])] + [pa.array(f[c]) for c in names[2:]], names)

        return d.mapInArrow(run, schema), shipped

    found: list[DataFrame] = []
    last = None
    for block in _blocks(bench, item_id, item_text):
        if last is not None:
            found.append(cut(last[0]))
            last[1].unpersist()
        last = search(*block)
    if last is None:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [*found, last[0]]).distinct()


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of a benchmark item go, with every row of their id; all others stay, as they are.

    Rows without id or text stay, as do empty texts; an empty table stays empty, and an empty benchmark takes nothing. The columns
    are those of ``docs``, whatever their names.
    """
    return without(docs, cut(overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()))
