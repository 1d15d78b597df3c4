"""Vectorised text primitives shared by the training-data operators.

Everything here works on whole Arrow string columns at once: the UTF-8 bytes of
many texts lie in one buffer, and words, windows and pre-tokens are hashed with
a handful of numpy passes over that buffer instead of a Python call per word.

Hash of a byte range ``[s, e)``: with ``B`` odd, ``H[k] = sum_{j<k} T[byte_j] * B**j``
(all arithmetic modulo 2**64), the range value is ``(H[e] - H[s]) * B**-s``. ``B`` is
invertible modulo 2**64, so the value depends on the bytes alone and not on where
the range lies. Operators that need exactness verify a hash hit against content.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 3 << 17

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII that is no letter or digit; what is beyond ASCII belongs to words.
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POW: dict[str, np.ndarray] = {}
#: glibc's; elsewhere there is none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept and grown by doubling."""
    have = _POW.get(name)
    if have is None or len(have) < n:
        out = np.full(max(1 << 16, 1 << int(n - 1).bit_length()), base, dtype=np.uint64)
        out[0] = 1
        have = _POW[name] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray, own: bool = False) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the result; in place if ``own``."""
    x = x if own else x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, that leaves a small worker behind.

    Spark keeps a worker for other tasks and takes them in turn, and the allocators keep what was freed: without this every
    worker of an executor, not only those at work, is as large as its largest task was.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Gives the system back what was freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def as_string_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array; null texts stay null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())


def valid(col: pa.Array) -> pa.Array:
    """The texts with U+FFFD for what isn't UTF-8, as a large_string array."""
    col = as_string_array(col)
    try:
        col.validate(full=True)
        return col
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in col.cast(pa.large_binary()).to_pylist()], pa.large_string())


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; a null text is an empty range."""
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most ``limit`` bytes of text (or one row)."""
    n = batch.num_rows
    if not n:
        return
    col = as_string_array(batch.column(batch.schema.get_field_index(text)))
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Prefix:
    """Running hash of a byte buffer, from which any byte range's hash is taken."""

    __slots__ = ("h", "inv")

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.h = np.empty(n + 1, np.uint64)
        self.h[0] = 0
        np.cumsum(_BYTE_VALUE[raw] * _powers("b", _B, n + 1)[:n], out=self.h[1:])
        self.inv = _powers("i", _B_INV, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes have equal hashes."""
        out = self.h[end] - self.h[start]
        out *= self.inv[start]
        out ^= (end - start).astype(np.uint64)
        return mix(out, True)


def range_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Prefix(raw)(start, end)


class Words:
    """Words of a slice of texts, separated by white space (ASCII), or by ASCII marks too.

    ``start``/``end`` are byte positions in ``raw``, ``first[d] .. first[d + 1]`` the
    words of text ``d`` and ``hash`` their 64-bit hashes.
    """

    __slots__ = ("end", "first", "hash", "off", "prefix", "raw", "start")

    def __init__(self, col: pa.Array, fold: bool = True):
        """``fold``: words are lower-cased and marks separate them, so that a copy with other
        case or punctuation has the same words."""
        self.raw, self.off = buffer_of(pc.utf8_lower(valid(col)) if fold else as_string_array(col))
        self.start, self.end, self.first = word_spans(self.raw, self.off, _MARK if fold else _SPACE)
        self.prefix = Prefix(self.raw)
        self.hash = self.prefix(self.start, self.end)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_spans(raw: np.ndarray, off: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words; a word never crosses the end of a text."""
    n = len(raw)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~apart[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = off[(off > 0) & (off < n)]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values of ``h``; crosses text ends."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = np.empty(len(h) + 1, np.uint64)
    p[0] = 0
    np.cumsum(h * _powers("b", _B, len(h)), out=p[1:])
    return mix((p[width:] - p[:n]) * _powers("i", _B_INV, n), True)


def inside(doc: np.ndarray, width: int) -> np.ndarray:
    """Mask over window starts: the window of ``width`` words lies in one text."""
    n = len(doc) - width + 1
    return doc[:n] == doc[width - 1 :] if n > 0 else np.empty(0, bool)


def planes(a: np.ndarray) -> bytes:
    """Differences of an integer column, byte by byte apart: small steps compress to nothing."""
    return np.ascontiguousarray(np.diff(a.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its high bits."""
    return ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def split(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places that hold it), in order of the number; the places stay in their order."""
    order = np.argsort(number.astype(np.uint16) if len(number) and number.max() < 1 << 16 else number, kind="stable")
    found = number[order]
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
    for b, lo, hi in zip(found[first].tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield b, order[lo:hi]
