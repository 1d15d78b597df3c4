"""Language-model scoring by online logistic context mixing.

A text is a row of symbols, and each symbol is one or several bits that are predicted from what
comes before it:

* A *byte* is coded along a prefix code, of which there is one for each last byte and for each of the most frequent
  last two bytes, so that the usual next byte takes few bits. They are predicted by the context that chose the code and by a
  hashed one of three bytes, whose odds come from byte counts over every document of the corpus, and by two
  more hashed contexts whose odds are learned online, within the text.
* A *flag* stands before a word whose context, the three words before it, has occurred before in the text, or some other
  document of the corpus holds too: does the word follow that followed it last, or followed it there most often? If so, it and the
  blanks after it are known and cost no further bits; if not, its bytes come next. The flag is predicted by
  the counts of the continuation, by how many flags before it came true, and by what the text has
  taught so far.

The logits of a bit are combined by weights, which a gate chooses among several sets (depth in the
code and kind of the last byte; for flags, how many came true before). Weights, learned odds and an
adaptive map, which refines the mixed probability, are corrected after each symbol. The sum of the
bits' costs, divided by the bytes, is the score.

What is gathered from the corpus: byte counts in ``TREES * SLOTS`` contexts, summed by a shuffle and broadcast; and
all contexts of three words with the words that follow them, which grow with the corpus and are
never held in one place: each document sends its contexts to buckets of their hashes, where the
continuations of all documents are counted, and gets back those of other documents. A document
counts once for a context, with what follows it there first, and its own part in the counts is left out.

A lane is a whole text, so nothing starts anew within it. Lanes don't depend on each other: hundreds
advance together, symbol by symbol, in numpy arrays, the longest first, and the last ``NARROW`` go
on one by one in plain Python. Texts of like length are scored in one place, so that lanes end together.
How they are grouped changes a result by rounding only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import cut, table

#: Pairs of last bytes that have a code of their own, all codes, and slots of the byte before under each of them.
PAIRS = 256
TREES, SLOTS = 256 + PAIRS, 32
#: Words of a context whose continuations are gathered.
WORDS = 3
#: Lanes that advance together, symbols that are laid out at once, and lanes too few for numpy.
GROUP, LAID, NARROW = 512, 1 << 14, 2
#: Bytes that are counted at once, contexts that a task holds before it sends them, and bytes of text scored together.
CHUNK, HELD, PART_BYTES = 4 << 20, 1_000_000, 8 << 20
#: Texts up to this power of two have one length class.
SHORT = 9
#: Slots of what a lane learns itself; sets of weights for bytes and flags; cells of the adaptive map for each set.
OWN, BYTE_GATES, RUNS, CELLS = 1 << 11, 32, 8, 16
GATES = BYTE_GATES + 2 * RUNS
#: Level of a continuation that the text itself holds; those of the corpus are even and smaller.
OWN_LEVEL = 127
RATE, OWN_RATE, MAP_RATE, START = 0.02, 0.5, 0.02, 0.35
#: The adaptive map learns no smaller probability.
LEAST = 2.0**-12
SCALE, STEEP = 15.0, 1.25
_FLAG = 255  # the number that inner nodes of the code leave free
_CENTRE = (1 / (1 + np.exp(-(np.arange(CELLS) + 0.5 - CELLS / 2) / STEEP))).astype(np.float32)
_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])
_K, _K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_LOW = np.uint64(0xFFFFFFFF)


# corpus counts of bytes


def back_bytes(raw: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The last byte, last but one, ... before each byte; before a text's start there are zeros."""
    early = [off[:-1][np.diff(off) > j] + j for j in range(n)]  # the first byte of each text, its second, ...
    out = []
    for k in range(1, n + 1):
        b = np.zeros(len(raw), np.uint32)
        b[k:] = raw[: max(0, len(raw) - k)]
        for at in early[:k]:
            b[at] = 0
        out.append(b)
    return out


def pair_of(back: list[np.ndarray]) -> np.ndarray:
    return back[0] | back[1] << np.uint32(8)


def slot_of(third: np.ndarray) -> np.ndarray:
    """Slot of the last but two byte under a code."""
    return (third * _K >> np.uint32(33 - SLOTS.bit_length())).astype(np.int64)


def count_bytes(texts: list[tuple[np.ndarray, np.ndarray]], tree_of: np.ndarray, sums: np.ndarray) -> None:
    """Adds the bytes of some texts, (bytes, offsets) of each slice, to the counts of their contexts."""
    found = [np.empty(0, np.int64)]
    for raw, off in texts:
        back = back_bytes(raw, off, 3)
        found.append((tree_of[pair_of(back)].astype(np.int64) * SLOTS + slot_of(back[2])) * 256 + raw)
    sums += np.bincount(np.concatenate(found), minlength=len(sums)).astype(sums.dtype)


def choose_trees(pairs: np.ndarray) -> np.ndarray:
    """The code that each pair of last bytes has, from the counts of pairs: its own, or that of the last byte."""
    tree_of = (np.arange(1 << 16) & 255).astype(np.uint16)
    own = np.argsort(-pairs, kind="stable")[:PAIRS]
    tree_of[own] = 256 + np.arange(len(own))
    return tree_of


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A prefix code for byte counts ``SLOTS x 256``: (bits of each byte, their steps one after another, depth of each node, logits).

    A step is a node (0 to 254, the root first) and the bit taken there (256). The logits are int8, ``1 + SLOTS x 256``: for
    all counts together and for each slot. One occurrence of each byte in each context is left out of them, as it may be the scored text's own:
    what only one text holds doesn't count as known.
    """
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts.sum(0))]
    heapq.heapify(heap)
    child: dict[int, tuple[int, int]] = {}
    name = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        child[name] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], name, name))
        name += 1
    order = {heap[0][2]: 0}
    ones, both = np.zeros((255, 256), bool), np.zeros((255, 256), bool)
    depth = np.zeros(256, np.uint8)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack = [(heap[0][2], [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
            for i, bit in path:
                both[i, node] = True
                ones[i, node] = bool(bit)
            continue
        i = order.setdefault(node, len(order))
        depth[i] = len(path)
        for bit in (0, 1):
            stack.append((child[node][bit], [*path, (i, bit)]))
    c = np.maximum(np.concatenate([counts.sum(0)[None], counts]) - 1, 0).astype(float)
    n1, n = c @ ones.T, c @ both.T
    logits = np.zeros((1 + SLOTS, 256), np.int8)
    logits[:, :255] = np.round(np.clip(np.log((n1 + 0.4) / (n - n1 + 0.4)), -8, 8) * SCALE)
    return np.array([len(p) for p in paths], np.uint8), np.array([i | b << 8 for p in paths for i, b in p], np.uint16), depth, logits


# contexts of words


def contexts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first byte, byte after its last, hash of the context, hash of the word, place of the word whose context
    in the text was the same last, or -1) of all words that have ``WORDS`` words before them; blanks belong to the word before them."""
    start, _, first = V.word_spans(raw, off)
    stop = np.append(start[1:], len(raw))[: len(start)]
    some = np.flatnonzero(np.diff(first))
    stop[first[some + 1] - 1] = off[some + 1]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(start)) - first[doc] >= WORDS)
    h = V.Prefix(raw)
    doc, begin, end = doc[at], start[at], stop[at]
    c = h(start[at - WORDS], begin)
    # texts and contexts together in order of their hash, and of their place where that is equal; places are its low bits
    low = np.uint64((1 << int(len(at)).bit_length()) - 1)
    tag = V.mix(c ^ V.mix(doc.astype(np.uint64) + np.uint64(1)))
    tag = np.sort(tag & ~low | np.arange(len(at), dtype=np.uint64))
    order = (tag & low).astype(np.int64)
    a, b = order[:-1], order[1:]
    same = (c[a] == c[b]) & (doc[a] == doc[b])
    last = np.full(len(at), -1)
    last[b[same]] = a[same]
    return doc, begin, end, c, h(begin, end), last


def _requests(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed contexts of all texts, the first of each in a text: (bucket, contexts, words, keys, news)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        c, w, key = (np.concatenate(x) for x in zip(*held))
        rows = []
        for b, at in V.split(V.bucket(c, buckets)):
            k = key[at]
            new = np.r_[True, k[1:] != k[:-1]]
            rows.append((b, (c[at] & _LOW).astype(np.uint32).tobytes(), w[at].tobytes(), k[new].tobytes(), np.packbits(new).tobytes()))  # a word is three bytes
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "contexts", "words", "keys", "news"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in V.slices(batch):
                raw, off = V.buffer_of(V.as_string_array(part.column(1)))
                doc, _, _, c, w, last = contexts(raw, off)
                at = np.flatnonzero(last < 0)
                held.append((c[at], w[at].view(np.uint8).reshape(-1, 8)[:, :3], part.column(0).to_numpy(zero_copy_only=False)[doc[at]]))
                n += len(at)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "bucket int, contexts binary, words binary, keys binary, news binary")


def continuations(c: np.ndarray, w: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, context, level, whether it is the document's own): what follows each context most often in other documents.

    A record (context, word, key) is a document's first use of a context. Of the words that follow
    a context elsewhere the one in most documents is taken, of equal ones that with the least hash.
    ``level`` is the scaled logit of its share. Nothing is said where no other document has the context; equal
    keys (equal texts) get one answer.
    """
    pair = c.astype(np.uint64) << np.uint64(32) | w
    order = np.argsort(pair)
    pair, key = pair[order], key[order]
    # contexts that occur once are no other document's
    ctx = pair >> np.uint64(32)
    alone = np.r_[True, ctx[1:] != ctx[:-1], True]
    some = ~(alone[:-1] & alone[1:])[: len(pair)]
    pair, key = pair[some], key[some]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    n = np.diff(np.r_[first, len(pair)])
    kind = pair[first]
    ctx = kind >> np.uint64(32)
    best_first = np.lexsort((kind, -n, ctx))
    head = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]][: len(ctx)])  # ``ctx`` is in order already
    size = np.diff(np.r_[head, len(ctx)])
    one = best_first[head]
    two = best_first[np.minimum(head + 1, len(ctx) - 1)]
    total, number = np.add.reduceat(n, head) if len(head) else n, np.repeat(np.arange(len(head)), size)
    n1, n2 = n[one][number], np.where(size > 1, n[two], 0)[number]
    w1, w2 = kind[one][number], kind[two][number]
    own = np.arange(len(kind)) == one[number]
    left = n1 - own
    second = own & (n2 > 0) & ((n2 > left) | ((n2 == left) & (w2 < w1)))
    count = np.where(second, n2, left)
    others = total[number] - 1
    level = np.round(np.clip(np.log((count + 0.4) / (others - count + 0.4)), -8, 8) * SCALE).astype(np.int8)
    rec = np.repeat(np.arange(len(kind)), n)
    order = np.lexsort((rec, key))
    rec, key = rec[order], key[order]
    once = np.r_[True, (rec[1:] != rec[:-1]) | (key[1:] != key[:-1])][: len(rec)]
    rec, key = rec[once], key[once]
    return key, ctx[rec].astype(np.uint32), level[rec], (own & ~second)[rec]


class Parts:
    """Where each text is scored: together with texts of its length class, as many parts for each as its bytes need.

    A text's key is a hash of it, whose last five bits are its class.
    """

    def __init__(self, sizes: dict[int, int]):
        self.n = [max(1, -(-sizes.get(c, 0) // PART_BYTES)) for c in range(32)]
        self.base = [sum(self.n[:c]) for c in range(32)]

    @staticmethod
    def key(text: Column) -> Column:
        size = F.floor(F.log2(F.greatest(F.octet_length(text), F.lit(1)))).cast("long")
        return F.xxhash64(text).bitwiseAND(F.lit(-32)).bitwiseOR(F.least(F.greatest(F.coalesce(size, F.lit(0)), F.lit(SHORT)), F.lit(31)))

    def of(self, key: Column) -> Column:
        pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (key.bitwiseAND(F.lit(31)) + 1).cast("int"))
        return (pick(self.base) + F.pmod(F.shiftright(key, 5), pick(self.n))).cast("int")

    def numbers(self, key: np.ndarray) -> np.ndarray:
        return (np.array(self.base)[key & 31] + (key >> 5) % np.array(self.n)[key & 31]).astype(np.int32)


def known(docs: DataFrame, buckets: int, parts: Parts) -> DataFrame:
    """(part, keys, sizes, contexts, levels): answers packed by the part of the documents that asked; ``docs`` holds key and text.

    A level's last bit says whether the continuation is the document's own."""

    def run(t: pa.Table) -> pa.Table:
        c = np.concatenate([np.frombuffer(x, np.uint32) for x in t["contexts"].to_pylist()])
        w = np.zeros((len(c), 4), np.uint8)
        w[:, :3] = np.concatenate([np.frombuffer(x, np.uint8) for x in t["words"].to_pylist()]).reshape(-1, 3)
        keys = []
        for k, new, x in zip(t["keys"].to_pylist(), t["news"].to_pylist(), t["contexts"].to_pylist()):
            keys.append(np.frombuffer(k, np.int64)[np.cumsum(np.unpackbits(np.frombuffer(new, np.uint8), count=len(x) // 4), dtype=np.int64) - 1])
        key, c, level, hit = continuations(c, w.view(np.uint32).ravel(), np.concatenate(keys))
        level = (level.astype(np.int16) & ~1 | hit).astype(np.int8)
        rows = []
        for p, at in V.split(parts.numbers(key)):
            k = key[at]
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            rows.append((p, k[head].tobytes(), np.diff(np.r_[head, len(k)]).astype(np.uint32).tobytes(), c[at].tobytes(), level[at].tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        return pa.table({name: pa.array(x, pa.int32() if name == "part" else pa.binary()) for name, x in zip(("part", "keys", "sizes", "contexts", "levels"), cols)})

    return _requests(docs, buckets).groupBy("bucket").applyInArrow(run, "part int, keys binary, sizes binary, contexts binary, levels binary")


# scoring


class Symbols:
    """The symbols of some texts: bytes, and flags before words whose continuation is known."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, start: np.ndarray, stop: np.ndarray, hit: np.ndarray, level: np.ndarray):
        """``start``, ``stop``: bytes of the words with a flag, in order; ``hit``: the flag is true; ``level``: OWN_LEVEL where the text
        itself says what comes."""
        n = len(raw)
        self.raw, self.level, self.hit = raw, level, hit
        # the last four bytes before each byte, the last one lowest; zeros before a text's start
        self.back = np.zeros(n, np.uint32)
        for k in (1, 2, 3, 4):
            self.back[k:] |= raw[: max(0, n - k)].astype(np.uint32) << np.uint32(8 * (k - 1))
        for k in (0, 1, 2, 3):
            early = off[:-1][np.diff(off) > k] + k
            self.back[early] &= np.uint32((1 << 8 * k) - 1)
        cover = np.zeros(n + 1, np.int8)
        cover[start[hit]] += 1
        cover[stop[hit]] -= 1  # words don't overlap
        known = np.cumsum(cover[:n], dtype=np.int8) > 0
        flag = np.zeros(n, bool)
        flag[start] = True
        per = flag.astype(np.int8) + ~known
        upto = np.zeros(n + 1, np.int32 if n < 1 << 30 else np.int64)
        np.cumsum(per, out=upto[1:])
        self.pos = np.repeat(np.arange(n, dtype=upto.dtype), per)
        self.pos[upto[:-1][flag]] ^= -1  # flags
        self.first, self.count = upto[off[:-1]].astype(np.int64), np.diff(upto[off]).astype(np.int64)
        # flags of the same text that came true right before each flag
        k = np.arange(len(start))
        text = np.searchsorted(off, start, "right")
        fresh = np.r_[True, text[1:] != text[:-1]][: len(start)]
        stop_at = np.where(fresh, k, 0)
        stop_at[1:] = np.maximum(stop_at[1:], np.where(hit[:-1], 0, k[1:]))
        self.run = np.minimum(k - np.maximum.accumulate(stop_at), RUNS - 1) + RUNS * (level == OWN_LEVEL)
        self.start = start


class Model:
    """The codes and the logits of all byte contexts."""

    def __init__(self, tree_of: np.ndarray, trees: dict[int, tuple[np.ndarray, ...]], total: int = 0):
        """``trees``: what ``tree`` gives, by number; codes that the corpus has no use for may be missing."""
        self.tree_of, self.total = tree_of, total
        none = tree(np.zeros((SLOTS, 256), np.int64)) if len(trees) < TREES else ()
        sizes, steps, depths, logits = zip(*(trees.get(t, none) for t in range(TREES)))
        # "bytes" 256 and 257 are flags, false and true
        flags = np.array([_FLAG, _FLAG | 256], np.uint16)
        self.size = np.concatenate([np.r_[x, 1, 1] for x in sizes]).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.step = np.concatenate([x for s in steps for x in (s, flags)])
        # behind the contexts: every level of a flag, and the input of a flag that never changes
        self.logits = np.r_[np.concatenate(logits).ravel(), np.arange(-128, 128), SCALE].astype(np.int8)
        self.gate_of = np.minimum(np.concatenate(depths), BYTE_GATES // 2 - 1).astype(np.int64)
        self.gate_of[_FLAG::256] = 0
        # where a node's learned odds lie among those of its context
        self.place_of = (np.arange(256, dtype=np.uint32) * _K2 >> np.uint32(34 - OWN.bit_length())).astype(np.int64)

    def score(self, raw: np.ndarray, off: np.ndarray, flags: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Bits of each text. ``flags``: first byte, byte after the last, whether true, and level of the words with a flag."""
        none = np.empty(0, np.int64)
        s = Symbols(raw, off, *(flags or (none, none, none.astype(bool), none.astype(np.int8))))
        out = np.zeros(len(off) - 1)
        order = np.argsort(-s.count, kind="stable")[: np.count_nonzero(s.count)]
        for lo in range(0, len(order), GROUP):
            g = order[lo : lo + GROUP]
            out[g] = self._lanes(s, g)
        return out

    def _inputs(self, s: Symbols, lanes: np.ndarray, at: int, steps: int) -> tuple[np.ndarray, ...]:
        """Bits of the symbols ``at`` to ``at + steps`` of each lane, all first symbols, then all second ones, ...: (inputs,
        set of weights, two slots of what the lane learns, bit, where each symbol's bits begin, its lane, where each step's bits begin)."""
        behind = len(self.logits) - 257
        if at + steps <= s.count[lanes[-1]]:  # no lane ends here
            upto = np.arange(1, steps + 1) * len(lanes)
            lane = np.tile(np.arange(len(lanes)), steps)
            idx = (s.first[lanes] + np.arange(at, at + steps)[:, None]).ravel()
        else:
            live = np.searchsorted(-s.count[lanes], -(at + np.arange(steps)), "left")
            upto = np.cumsum(live)
            lane = np.arange(upto[-1]) - np.repeat(upto - live, live)
            idx = s.first[lanes][lane] + np.repeat(at + np.arange(steps), live)
        pos = s.pos[idx]
        flag = pos < 0
        pos ^= -flag.astype(pos.dtype)
        back = s.back[pos]
        tree = self.tree_of[back & np.uint32(0xFFFF)].astype(np.int64)
        # what belongs to a symbol: rows of logits, slots of the learned contexts, place in the code, gate, lane, tree
        own, high = np.empty((len(lane), 8), np.uint32), np.uint32(34 - OWN.bit_length())
        own[:, 0] = tree * ((1 + SLOTS) * 256)
        own[:, 1] = own[:, 0] + (1 + slot_of(back >> np.uint32(16) & np.uint32(255))) * 256
        one = (tree + 1).astype(np.uint32) * _K
        long = (back & np.uint32(0xFFFFFF)) * _K2 ^ (back >> np.uint32(24)) * _K
        own[:, 5] = lane * GATES + BYTE_GATES // 2 * _LETTER[back & np.uint32(255)]
        own[:, 7] = tree * 256
        byte = tree * 258 + s.raw[pos]
        known = np.flatnonzero(flag)
        if len(known):
            f = np.searchsorted(s.start, pos[known])
            run, level = s.run[f], s.level[f].astype(np.int64)
            byte[known] = 256 + s.hit[f]
            own[known, 0], own[known, 1] = behind + level + 128 - _FLAG, behind + 256 - _FLAG
            one[known], long[known] = (run + 1).astype(np.uint32) * _K2, (level + 1000).astype(np.uint32) * _K
            own[known, 5] = lane[known] * GATES + BYTE_GATES + run
            own[known, 7] = 0
        own[:, 2], own[:, 3] = lane * OWN + (one * _K >> high), lane * OWN + OWN // 2 + (long * _K >> high)
        size = self.size[byte]
        stop = np.cumsum(size)
        own[:, 4] = self.first[byte] - (stop - size)
        # what belongs to a bit; four numbers move as one item
        own = own.view(np.complex128)
        ctx, own = (np.repeat(own[:, i], size).view(np.uint32).reshape(-1, 4) for i in (0, 1))
        src = own[:, 0] + np.arange(len(own), dtype=np.uint32)
        step = self.step.take(src.astype(np.int64))
        node = (step & np.uint16(255)).astype(np.int64)
        x, learned = np.empty((len(src), 4), np.float32), np.empty((2, len(src)), np.int64)
        for i in (0, 1):
            np.multiply(self.logits.take(ctx[:, i] + node), np.float32(1 / SCALE), out=x[:, i])
        place = self.place_of.take(node)
        for i in (0, 1):
            np.bitwise_xor(ctx[:, 2 + i], place, out=learned[i])
        gate = self.gate_of.take(own[:, 3] + node)
        gate += own[:, 1]
        return x, gate, learned, (step >> np.uint16(8)).astype(np.float32), stop - size, lane, np.r_[0, np.r_[0, stop][upto]]

    def _lanes(self, s: Symbols, lanes: np.ndarray) -> np.ndarray:
        """Bits of some lanes, the longest first, that advance together."""
        n, count = len(lanes), s.count[lanes]
        total = np.zeros(n)
        # weights are kept in units of RATE and what a lane learns in units of OWN_RATE: updates add plain errors
        W = np.full((n * GATES, 4), START / RATE, np.float32)
        Wc = W.view(np.complex128).ravel()  # a set of four weights moves as one item
        A = np.zeros(n * OWN, np.float32)
        R = np.tile(_CENTRE, n * GATES)
        one, minus, own_rate = np.float32(1), np.full((4, 4), -RATE, np.float32), np.float32(OWN_RATE)
        steep, middle, top, zero = np.float32(-STEEP), np.float32(CELLS / 2), np.float32(CELLS - 1), np.float32(0)
        keep, map_rate = np.float32(1 - MAP_RATE), np.float32(MAP_RATE)
        at = 0
        while (m := int(np.count_nonzero(count > at))) > NARROW:
            steps = int(min(max(8, LAID // m), count[0] - at))
            X, G, O, Y, symbol, lane, edge = self._inputs(s, lanes[:m], at, steps)
            Q = np.empty(len(Y), np.float32)
            C, L, Y4 = G * CELLS, Y * (map_rate * np.float32(1 - 2 * LEAST)) + map_rate * np.float32(LEAST), np.repeat(Y, 4).reshape(-1, 4)
            most = int(np.diff(edge).max())
            bw, ba, bf, bc = np.empty(most, np.complex128), np.empty(2 * most, np.float32), np.empty((2, most), np.float32), np.empty(most, np.int64)
            b4, bd = np.empty((most, 4), np.float32), np.empty((most, 4), np.float32)
            with np.errstate(over="ignore"):
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    k = hi - lo
                    x, gi, oi = X[lo:hi], G[lo:hi], O[:, lo:hi]
                    w, a, r, dot, cell, e4, p4 = bw[:k], ba[: 2 * k].reshape(2, k), bf[0, :k], bf[1, :k], bc[:k], b4[:k], bd[:k]
                    w4 = w.view(np.float32).reshape(k, 4)
                    A.take(oi, out=a, mode="clip")
                    np.multiply(a[0], own_rate, out=x[:, 2])
                    np.multiply(a[1], own_rate, out=x[:, 3])
                    Wc.take(gi, out=w, mode="clip")
                    # each bit's numbers stay four times side by side, so that no step is over pairs of arrays of unlike shape
                    np.multiply(w4, x, out=e4)
                    np.matmul(e4, minus, out=p4)
                    np.multiply(p4[:, 0], steep, out=dot)
                    np.exp(p4, out=p4)
                    p4 += one
                    np.reciprocal(p4, out=p4)
                    np.subtract(Y4[lo:hi], p4, out=e4)
                    # weights, and what the lane learns itself
                    a += e4[:, 0]
                    A[oi] = a
                    e4 *= x
                    w4 += e4
                    Wc[gi] = w
                    # refinement
                    dot += middle
                    np.maximum(dot, zero, out=dot)
                    np.minimum(dot, top, out=dot)
                    np.copyto(cell, dot, casting="unsafe")
                    cell += C[lo:hi]
                    R.take(cell, out=r, mode="clip")
                    np.add(p4[:, 0], r, out=Q[lo:hi])
                    r *= keep
                    r += L[lo:hi]
                    R[cell] = r
            # the mean of both probabilities, of the bit that came
            Q *= np.float32(0.5)
            Q -= Y
            np.abs(Q, out=Q)
            np.subtract(one, Q, out=Q)
            np.maximum(Q, np.float32(1e-5), out=Q)
            total[:m] -= np.bincount(lane, np.add.reduceat(np.log2(Q, out=Q), symbol), m)
            at += steps
        for k in range(m):
            state = W[k * GATES : (k + 1) * GATES].tolist(), A[k * OWN : (k + 1) * OWN].tolist(), R[k * GATES * CELLS : (k + 1) * GATES * CELLS].tolist()
            for lo in range(at, int(count[k]), LAID):
                X, G, O, Y, _, _, edge = self._inputs(s, lanes[k : k + 1], lo, min(LAID, int(count[k]) - lo))
                total[k] += _one(X, G, O, Y, edge, *state)
        return total


def _one(X: np.ndarray, G: np.ndarray, O: np.ndarray, Y: np.ndarray, edge: np.ndarray, W: list[list[float]], A: list[float], R: list[float]) -> float:
    """Bits of one lane, whose weights, learned odds and map are changed in place."""
    bits = list(zip(X[:, 0].tolist(), X[:, 1].tolist(), G.tolist(), O[0].tolist(), O[1].tolist(), Y.tolist()))
    exp, prob, map_keep, low, high = math.exp, [], 1 - MAP_RATE, MAP_RATE * LEAST, MAP_RATE * (1 - LEAST)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        new = []
        for x0, x1, gate, o2, o3, bit in bits[lo:hi]:
            (w0, w1, w2, w3), a2, a3 = W[gate], A[o2], A[o3]
            x2, x3 = a2 * OWN_RATE, a3 * OWN_RATE
            dot = (w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3) * RATE
            p = 1 / (1 + exp(-dot)) if dot > -80 else 0.0
            e = bit - p
            c = dot * STEEP + CELLS / 2
            cell = gate * CELLS + (0 if c < 0 else int(c) if c < CELLS - 1 else CELLS - 1)
            r = R[cell]
            q = (p + r) / 2
            prob.append(q if bit else 1 - q)
            new.append((gate, [w0 + e * x0, w1 + e * x1, w2 + e * x2, w3 + e * x3], o2, a2 + e, o3, a3 + e, cell, r * map_keep + (high if bit else low)))
        # as in the arrays: what one symbol's bits share keeps the last bit's correction
        for gate, w, o2, a2, o3, a3, cell, r in new:
            W[gate], A[o2], A[o3], R[cell] = w, a2, a3, r
    return float(-np.log2(np.maximum(prob, 1e-5)).sum())


def _summed(docs: DataFrame, size: int, block: int, add) -> DataFrame:
    """(block, counts int64): sums over all documents, of which ``add`` adds some slices' to an array of ``size`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, n = np.zeros(size, np.uint32), [], 0
        for batch in batches:
            for part in V.slices(batch):
                held.append(V.buffer_of(V.as_string_array(part.column(1))))
                n += len(held[-1][0])
                if n >= CHUNK:
                    add(held, sums)
                    held, n = [], 0
        add(held, sums)
        blocks = sums.reshape(-1, block)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

    def total(t: pa.Table) -> pa.Table:
        s = np.zeros(block, np.int64)
        for x in t["counts"].to_pylist():
            s += np.frombuffer(x, np.uint32)
        return pa.table({"block": t["block"].slice(0, 1), "counts": pa.array([s.tobytes()], pa.binary())})

    return docs.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(total, "block int, counts binary")


def _add_pairs(texts: list[tuple[np.ndarray, np.ndarray]], sums: np.ndarray) -> None:
    sums += np.bincount(np.concatenate([np.empty(0, np.uint32), *(pair_of(back_bytes(raw, off, 2)) for raw, off in texts)]), minlength=len(sums)).astype(sums.dtype)


def train(docs: DataFrame) -> Model:
    """The codes and the byte contexts of a corpus given as key and text."""
    pairs = np.zeros((256, 256), np.int64)
    for r in _summed(docs, 1 << 16, 256, _add_pairs).collect():  # 256 rows, whatever the corpus
        pairs[r["block"]] = np.frombuffer(r["counts"], np.int64)
    tree_of = choose_trees(pairs.ravel())
    sums = cut(_summed(docs, TREES * SLOTS * 256, SLOTS * 256, lambda texts, sums: count_bytes(texts, tree_of, sums)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = zip(*(map(np.ndarray.tobytes, tree(np.frombuffer(x, np.int64).reshape(SLOTS, 256))) for x in batch.column(1).to_pylist()))
            cols = list(got) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols)], ["block", "size", "step", "depth", "logits"])

    trees = {}
    for r in sums.mapInArrow(code, "block int, size binary, step binary, depth binary, logits binary").collect():  # TREES rows
        trees[r["block"]] = tuple(np.frombuffer(r[c], t) for c, t in (("size", np.uint8), ("step", np.uint16), ("depth", np.uint8), ("logits", np.int8)))
        trees[r["block"]] = (*trees[r["block"]][:3], trees[r["block"]][3].reshape(1 + SLOTS, 256))
    return Model(tree_of, trees, int(pairs.sum()))


def _score_part(model: Model, left: pa.Table, right: pa.Table) -> pa.Table:
    """Scores of the rows (part, doc_id, key, text) of one part, with the answers to their contexts; equal texts are scored once."""
    key, text = left["key"].to_numpy(), V.as_string_array(left["text"])
    own, at, row = np.unique(key, return_index=True, return_inverse=True)
    ask = lambda k, c: V.mix((c & _LOW) ^ V.mix(k.view(np.uint64)))
    flat = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in right[name].to_pylist())])
    tags = ask(np.repeat(flat("keys", np.int64), flat("sizes", np.uint32)), flat("contexts", np.uint32).astype(np.uint64))
    order = np.argsort(tags)
    tags, levels = tags[order], flat("levels", np.int8)[order]
    some = np.zeros(1 << 22, bool)  # spares most of the searches in vain
    some[tags >> np.uint64(42)] = True
    own_text = text.take(pa.array(at))
    found, lo, base = [], 0, 0
    for part in V.slices(pa.RecordBatch.from_arrays([own_text], ["text"])):
        raw, off = V.buffer_of(part.column(0))
        doc, start, stop, c, w, last = contexts(raw, off)
        hit, level = w == w[last], np.full(len(w), OWN_LEVEL, np.int8)
        new = np.flatnonzero(last < 0)
        known = last >= 0
        tag = ask(own[lo : lo + part.num_rows][doc[new]], c[new])
        maybe = np.flatnonzero(some[tag >> np.uint64(42)])
        place = np.searchsorted(tags, tag[maybe])
        place[place == len(tags)] = 0
        there = tags[place] == tag[maybe]
        asked, answer = new[maybe[there]], levels[place[there]]
        hit[asked], level[asked], known[asked] = answer & 1, answer & ~1, True
        found.append((start[known] + base, stop[known] + base, hit[known], level[known]))
        lo, base = lo + part.num_rows, base + len(raw)
    bits = model.score(*V.buffer_of(own_text), tuple(map(np.concatenate, zip(*found))) or None)[row]
    size = np.diff(V.buffer_of(text)[1])
    gone = text.is_null().to_numpy(zero_copy_only=False)
    columns = [left["doc_id"], pa.array(size, mask=gone), pa.array(bits, mask=gone), pa.array(bits / np.maximum(1, size), mask=gone | (size == 0))]
    return pa.table(columns, names=["doc_id", "n_bytes", "bits", "bits_per_byte"])


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row, in whatever order, under a model of all rows.

    A null text has null scores; an empty one costs no bits and has no ratio; a very long one is one
    lane. The score is a function of the text and the corpus, so equal texts have equal scores, and each counts as known
    to the others. Repeated rows and rows without id have a row each; extra columns are ignored; an empty table gives no rows;
    bytes that aren't UTF-8 are bytes as any other.
    """
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.select(Parts.key(text).alias("key"), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    corpus = d.where("text is not null").select("key", "text")
    model = train(corpus)
    sizes = corpus.groupBy(F.col("key").bitwiseAND(F.lit(31)).alias("c")).agg(F.sum(F.octet_length("text")).alias("n")).collect()  # 32 rows at most
    parts = Parts({r.c: r.n for r in sizes})
    # buckets follow the data's size too
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-model.total // PART_BYTES))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    rows = d.select(parts.of(F.col("key")).alias("part"), "doc_id", "key", "text").groupBy("part")
    run = lambda left, right: _score_part(shipped.value, left, right)
    return rows.cogroup(known(corpus, buckets, parts).groupBy("part")).applyInArrow(run, "doc_id long, n_bytes long, bits double, bits_per_byte double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
