"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by the usual byte-level pattern, evaluated with numpy over
character classes. The distinct pre-tokens of a slice are resolved once:

* tier 1: a minimal perfect hash over the vocabulary (hash, displace) sends a pre-token that
  is itself a token to its id; a stored key hash tells members from others;
* tier 2: what misses is merged by a heap of ranked pairs over a linked list of its bytes, and
  kept for later slices.

Decoding gathers the bytes of the ids; every text is decoded and compared with its original
byte by byte. Should two pre-tokens share a 64-bit hash, that comparison fails and the text
is encoded again without hashing.
"""

from __future__ import annotations

import base64
import heapq
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a task remembers; beyond it the memory starts anew.
MEMORY = 600_000
_LETTER, _NUMBER, _BLANK, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, as the pattern's own engine sees it."""
    points = [chr(i) if not 0xD800 <= i < 0xE000 else "" for i in range(0x110000)]
    whole = "".join(points)
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, p in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(p, whole):
            out[m.start() : m.end()] = kind
    return out


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: key -> place in ``0 .. n - 1``.

    Keys fall into buckets; each bucket, largest first, gets the least displacement that
    sends its keys to free places.
    """

    def __init__(self, keys: np.ndarray, load: int = 4):
        self.n = len(keys)
        self.buckets = max(1, self.n // load)
        b = self._bucket(keys)
        order = np.argsort(b, kind="stable")
        cuts = np.searchsorted(b[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(self.n, bool)
        place = np.empty(self.n, np.int64)
        free_from = 0
        for bucket in np.argsort(-np.diff(cuts), kind="stable"):
            members = order[cuts[bucket] : cuts[bucket + 1]]
            if not len(members):
                break
            if len(members) == 1:
                # the displacements of single keys name their place directly
                while taken[free_from]:
                    free_from += 1
                spot = np.array([free_from])
                self.shift[bucket] = np.uint64((1 << 63) | free_from)
            else:
                d = 0
                while True:
                    tries = np.arange(d, d + 64, dtype=np.uint64)
                    spots = (V.mix(keys[members][None, :] + (tries * np.uint64(0x9E3779B97F4A7C15))[:, None]) % np.uint64(self.n)).astype(np.int64)
                    good = ~taken[spots].any(1)
                    good &= np.array([len(set(s)) == len(s) for s in spots.tolist()])
                    if good.any():
                        d += int(np.argmax(good))
                        spot = spots[np.argmax(good)]
                        break
                    d += 64
                self.shift[bucket] = d
            taken[spot] = True
            place[members] = spot
        self.key = np.empty(self.n, np.uint64)
        self.key[place] = keys
        self.place = place

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (V.mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.buckets)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 for keys that aren't members."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        shift = self.shift[self._bucket(keys)]
        single = shift >> np.uint64(63) == 1
        spot = (V.mix(keys + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        spot[single] = (shift[single] & np.uint64((1 << 63) - 1)).astype(np.int64)
        return np.where(self.key[spot] == keys, spot, -1)


class Memory:
    """Ids of pre-tokens by hash, in columns sorted by it: some 40 bytes a pre-token, of which a dictionary takes 300."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.key, self.start, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used = np.empty(1 << 12, np.int32), 0

    def __len__(self) -> int:
        return len(self.key)

    def holds(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(key), bool)
        return self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] == key

    def add(self, key: np.ndarray, ids: list[list[int]]) -> None:
        """``key``: sorted, distinct, and none of them held."""
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        stop = np.cumsum(size) + self.used
        if len(stop) and stop[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(stop[-1], 3 * self.used // 2) - self.used, np.int32)])
        self.ids[self.used : self.used + size.sum()] = np.fromiter((x for one in ids for x in one), np.int32, size.sum())
        self.used += int(size.sum())
        at = np.searchsorted(self.key, key)
        self.key, self.start, self.size = (np.insert(a, at, b) for a, b in ((self.key, key), (self.start, stop - size), (self.size, size)))

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, ids), of keys that are held."""
        at = np.searchsorted(self.key, key)
        size = self.size[at]
        stop = np.cumsum(size)
        return size, self.ids[np.repeat(self.start[at] - (stop - size), size) + np.arange(size.sum())]

    def __setitem__(self, key: int, ids: tuple[int, ...]) -> None:
        one = np.array([key], np.uint64)
        if self.holds(one)[0]:
            del self[key]
        self.add(one, [list(ids)])

    def __delitem__(self, key: int) -> None:
        stays = self.key != np.uint64(key)
        self.key, self.start, self.size = self.key[stays], self.start[stays], self.size[stays]


class Codec:
    """Encoder and decoder of one vocabulary file (base64 token, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = list(self.ranks)
        ids = np.fromiter(self.ranks.values(), np.int64, len(tokens))
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        end = np.cumsum(size)
        key = V.range_hash(raw, end - size, end)
        self.hash = PerfectHash(key)
        self.id_at = np.empty(len(tokens), np.int64)
        self.id_at[self.hash.place] = ids
        # bytes of the tokens by id
        top = int(ids.max()) + 1 if len(ids) else 0
        self.size = np.zeros(top, np.int64)
        self.size[ids] = size
        self.at = np.zeros(top, np.int64)
        self.at[ids] = end - size
        self.raw = raw
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.memory = Memory()
        self.pattern = regex.compile(PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest ranked neighbouring pair is merged, again and again.

        Neighbours are links between positions of bytes; a heap holds the pairs that were
        possible when they were pushed, and those that changed since are skipped.
        """
        ranks = self.ranks
        n = len(piece)
        if n == 1:
            return [ranks[piece]]
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue
            end[i] = stop
            alive[j] = False
            if stop < n:
                prev[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0:
                r = ranks.get(piece[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_plain(self, text: str) -> list[int]:
        """One text without hashing: the pattern, then a dictionary or the heap."""
        out: list[int] = []
        for m in self.pattern.finditer(text):
            piece = m[0].encode()
            whole = self.ranks.get(piece)
            out.extend([whole] if whole is not None else self.merge(piece))
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts) of a column of texts; null and empty texts have no ids."""
        return self.encode_checked(col)[:2]

    def encode_checked(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and whether each text's ids decode to its very bytes."""
        col = pc.fill_null(V.as_string_array(col), "")
        raw, off = V.buffer_of(col)
        n = len(col)
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(n + 1, np.int64), np.ones(n, bool)
        start, first = pre_tokens(raw, off)
        end = np.append(start[1:], len(raw))
        key = V.range_hash(raw, start, end)
        uniq, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        spot = self.hash(uniq)
        size = np.ones(len(uniq), np.int64)
        miss = np.flatnonzero(spot < 0)
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        buf = raw.tobytes()
        new = miss[~memory.holds(uniq[miss])]
        memory.add(uniq[new], [self.merge(buf[s:e]) for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist())])
        size[miss], flat = memory.get(uniq[miss])
        base = np.r_[0, np.cumsum(size)]
        pool = np.empty(base[-1], np.int32)
        hit = spot >= 0
        pool[base[:-1][hit]] = self.id_at[spot[hit]]
        if len(miss):
            mask = np.ones(len(pool), bool)
            mask[base[:-1][hit]] = False
            pool[mask] = flat
        per = size[inverse]
        stop = np.cumsum(per)
        ids = pool[np.repeat(base[:-1][inverse] - (stop - per), per) + np.arange(stop[-1])]
        bounds = np.r_[0, stop][first]
        # the ids decode to the very bytes, text by text, or the text is done again
        back, back_off = self.decode(ids, bounds)
        ok = np.ones(n, bool)
        if not np.array_equal(back_off, off) or not np.array_equal(back, raw):
            got = []
            for i, text in enumerate(col.to_pylist()):
                one = ids[bounds[i] : bounds[i + 1]]
                if not np.array_equal(back[back_off[i] : back_off[i + 1]], raw[off[i] : off[i + 1]]):
                    one = np.array(self.encode_plain(text), np.int32)
                    ok[i] = self.decode(one, np.array([0, len(one)]))[0].tobytes() == text.encode()
                got.append(one)
            bounds = np.r_[0, np.cumsum([len(x) for x in got])]
            ids = np.concatenate(got)
        return ids, bounds, ok

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets of the texts) of ids split at ``bounds``."""
        if not len(ids):
            return np.empty(0, np.uint8), np.zeros(len(bounds), np.int64)
        size = self.size[ids]
        stop = np.cumsum(size)
        raw = self.raw[np.repeat(self.at[ids] - (stop - size), size) + np.arange(stop[-1])]
        return raw, np.r_[0, stop][bounds]


def pre_tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte of each pre-token, first pre-token of each text) for UTF-8 texts in one buffer."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    kind = _classes()[code]
    # texts by characters
    edge = np.searchsorted(at, off)
    inner = np.unique(edge[edge < n])
    opens = np.zeros(n + 1, bool)
    opens[inner] = True
    opens[n] = True
    begin = opens[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin[0] = True
    blank = kind == _BLANK
    # a run of blanks that more text follows gives its last blank away: to the token after it if that
    # blank is a space, else as a token of its own
    last = blank & ~opens[1:]
    last[:-1] &= ~blank[1:]
    last[n - 1] = False
    begin |= last
    space = last & (code == 32)
    after = np.flatnonzero(space) + 1
    begin[after] = False
    # contractions: an apostrophe that opens a run of other characters and has no space before it
    mark = (code == 39) & begin
    spots = np.flatnonzero(mark)
    if len(spots):
        pad = np.r_[code, np.zeros(3, np.uint32)].astype(np.int64)
        closed = np.r_[opens, np.ones(3, bool)]
        a, b = pad[spots + 1], pad[spots + 2]
        one = ~closed[spots + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~closed[spots + 1] & ~closed[spots + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for found, length in ((one, 2), (two, 3)):
            s = spots[found]
            begin[s + 1] = False
            stop = s + length
            begin[stop[stop < n]] = True
            # a blank that would be given to the next token still is: it begins its own token already
    start = at[np.flatnonzero(begin)]
    return start, np.searchsorted(start, off)


_CODEC: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, made once in each process."""
    if path not in _CODEC:
        _CODEC[path] = Codec(path)
    return _CODEC[path]


class Shipped:
    """A codec on its way to the workers: the tables, which only the vocabulary makes large, are
    built on the driver and unpacked once in each worker."""

    def __init__(self, path: str):
        self.path = path
        self.state = codec(path).__dict__

    def __getstate__(self) -> dict:
        keep = {k: v for k, v in self.state.items() if k not in ("memory", "pattern")}
        return {"path": self.path, "raw": pickle.dumps(keep, 5)}

    def __setstate__(self, state: dict) -> None:
        self.path, self.raw = state["path"], state["raw"]

    def get(self) -> Codec:
        if self.path not in _CODEC:
            c = Codec.__new__(Codec)
            c.__dict__ |= pickle.loads(self.raw)
            c.memory, c.pattern = Memory(), regex.compile(PATTERN)
            _CODEC[self.path] = c
        return _CODEC[self.path]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, decoded_ok) for every row, in whatever order.

    ``decoded_ok`` says that the ids decode to the text's very bytes. A null text has null in
    every other column; an empty text has no tokens, a very long one has all of its. Repeated rows and rows without id have a
    row each; extra columns are ignored; an empty table gives no rows. What isn't UTF-8 is read as U+FFFD, and counts so in ``n_bytes``. The
    vocabulary file is read on the driver only.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    shipped = Shipped(vocabulary)

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.get()
        try:
            for batch in batches:
                for part in V.slices(batch):
                    text = V.valid(part.column(1))
                    gone = text.is_null().to_numpy(zero_copy_only=False)
                    ids, bounds, ok = c.encode_checked(text)
                    off = V.buffer_of(text)[1]
                    tokens = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(gone) if gone.any() else None)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off), mask=gone), pa.array(np.diff(bounds), mask=gone), tokens, pa.array(ok, mask=gone)], ["doc_id", "n_bytes", "n_tokens", "tokens", "decoded_ok"])
        finally:
            c.memory.clear()  # the codec stays with the worker, what one task remembered doesn't

    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, tokens array<int>, decoded_ok boolean")


def detokenize(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text, no ids an empty one.

    Ids that don't make up whole characters give U+FFFD in their place.
    """
    d = tokens.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{tokens_col}`").cast("array<int>").alias("tokens"))

    shipped = Shipped(vocabulary)

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.get()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                bounds = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
                raw, off = c.decode(lists.flatten().to_numpy(zero_copy_only=False), bounds)
                raw = raw.tobytes()
                gone = lists.is_null().to_pylist()
                out = [None if g else raw[off[i] : off[i + 1]].decode("utf-8", "replace") for i, g in enumerate(gone)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(run, "doc_id long, text string")


def stage_tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that is left, as token ids, whatever columns it has: see ``tokenize`` for nulls, empty and long texts."""
    return tokenize(docs)
