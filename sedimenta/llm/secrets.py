"""Secret scan: the guess cost of values that stand in a credential's context.

A value counts as in context when it is assigned to a name such as ``password``, ``api_key`` or
``token``, or stands between a user and a host in a URL. Its cost is the least, over all ways
to cut it into dictionary words, dates, repeats, keyboard walks and brute-force spans, of the
sum of the pieces' guesses (in bits) and one bit for each piece. A placeholder or a common
password costs little; a real key costs nearly what its alphabet allows.

The least cost is found by dynamic programming over the value's positions: a brute-force span
grows by one character at a time, words and dates are listed beforehand, and every part of a
repeat or walk is tried at its end. Time grows with the square of a value's length.

The dictionary begins with frequent passwords and goes on with the whole words of a public tokenizer's vocabulary file, in
its order, which is about that of their frequency (``VOCABULARY``, a parameter, read on the driver only): some tens of
thousands. A word may be written backwards, capitalised or in leet, for a few bits more.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import table, texts

#: A value that costs at least so many bits is reported as a secret.
SECRET_BITS = 40.0
PIECE_BITS = 1.0

#: A vocabulary with word ends, whose whole words are the dictionary's larger part.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

#: Frequent passwords and parts of them, most frequent first; a word's rank is its guesses.
WORDS = tuple(
    """password admin welcome login qwerty letmein secret changeme test user root guest master dragon monkey shadow
    sunshine princess football baseball superman batman iloveyou love hello freedom whatever trustno mustang access
    hunter ranger killer pepper summer winter spring autumn monday friday january march april june july august
    september october november december michael jennifer jordan thomas charlie andrew daniel george robert jessica
    ashley computer internet server database oracle mysql postgres redis mongo docker cloud system manager service
    example sample demo dummy default temp temporary placeholder your token apikey key pass word name value string
    insert here enter none null true false todo fixme xxx yyy foo bar baz foobar company office public private
    prod production staging development debug local localhost home family forever angel flower cheese chicken cookie
    coffee banana orange purple yellow silver golden diamond tiger eagle falcon dolphin lion bear wolf horse
    soccer hockey tennis golf player gamer matrix phoenix thunder lightning rainbow starwars pokemon ninja samurai
    google amazon apple microsoft facebook twitter linux windows ubuntu debian the and for you not with this that
    black white green blue red pink happy lucky money dollar bank credit card number phone mobile email mail web
    site page file data code open source free best good great super mega ultra power magic secure security safe
    lock unlock crypto bitcoin wallet hash salt auth session cookie bearer basic client server""".split()
)


class Dictionary:
    """Ranks of words; the first is 1."""

    def __init__(self, words: tuple[str, ...] | list[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)


#: Without a vocabulary file.
BASIC = Dictionary(WORDS)


@lru_cache(4)
def dictionary(vocabulary: str | None) -> Dictionary:
    """The frequent passwords and then the file's whole words of three letters or more, in the order of their ids."""
    if vocabulary is None:
        return BASIC
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    ends = "</w>"
    more = [w[: -len(ends)] for w in sorted(ids, key=ids.get) if w.endswith(ends)]
    return Dictionary([*WORDS, *(w for w in more if len(w) > 2 and w.isalpha())])


_LEET = str.maketrans({"@": "a", "4": "a", "8": "b", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = dict(zip('~!@#$%^&*()_+QWERTYUIOP{}|ASDFGHJKL:"ZXCVBNM<>?', "`1234567890-=qwertyuiop[]\\asdfghjkl;'zxcvbnm,./"))
_KEY_AT = {c: (x + (0.0, 0.5, 0.75, 1.25)[y] + (0 if y == 0 else 1), y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_DEGREE, _STARTS = math.log2(4.6), math.log2(47)

_NAME = r"(?:passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_\-]?keys?|access[_\-]?keys?|private[_\-]?keys?|auth[_\-]?keys?|credentials?|authorization)"
_CONTEXT = re.compile(
    _NAME + r"(?:(?:[_\-]|[0-9]|(?-i:(?<=[a-z])[A-Z]))[A-Za-z0-9_\-]*+)?[\"']?[ \t]*+(?::=|=>|==|=|:)[ \t]*+"
    r"(?:(?:Bearer|Basic)[ \t]+)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'<>]+))",
    re.I,
)
_URL = re.compile(r"(?<=[A-Za-z0-9+.\-])://([^\s:/@]*):([^\s/@]+)@")
#: What a text must hold before it is looked at closely; the same names, for the JVM.
PREFILTER = r"(?i)passw|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth[_\-]?key|credential|authorization|://[^\s:/@]*:"
_IDENT = re.compile(r"[A-Za-z0-9_.\-]*")
_DATES = re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:19|20)\d\d|(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])[-/._]?(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")


def char_bits(value: str) -> float:
    """Bits of one brute-forced character: the size of the least usual alphabet that holds the value."""
    if re.fullmatch(r"[0-9]*", value):
        return math.log2(10)
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", value):
        return 4.0
    if re.fullmatch(r"[a-z]*|[A-Z]*", value):
        return math.log2(26)
    if re.fullmatch(r"[0-9a-z]*|[0-9A-Z]*", value):
        return math.log2(36)
    if re.fullmatch(r"[0-9A-Za-z]*", value):
        return math.log2(62)
    return math.log2(95)


def _adjacent(a: str, b: str) -> tuple[float, int] | None:
    """The step between two keys that lie side by side (or the same row's neighbours)."""
    p, q = _KEY_AT.get(_SHIFT.get(a, a)), _KEY_AT.get(_SHIFT.get(b, b))
    if p is None or q is None:
        return None
    dx, dy = q[0] - p[0], q[1] - p[1]
    if (dy == 0 and abs(dx) == 1) or (abs(dy) == 1 and abs(dx) < 1):
        return (1.0 if dx > 0 else -1.0, dy)
    return None


def _listed(value: str, words: Dictionary = BASIC) -> list[tuple[int, int, float, str]]:
    """(start, end, bits, kind) of every word and date in a value."""
    n = len(value)
    out = []
    # one character for one, so that positions stay
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + words.longest) + 1):
            least = None
            for text in (low, plain) if low[i:j] != plain[i:j] else (low,):
                for part, back in ((text[i:j], 0), (text[i:j][::-1], 1)):
                    rank = words.rank.get(part)
                    if rank:
                        upper = sum(c.isupper() for c in value[i:j])
                        leet = sum(a != b for a, b in zip(low[i:j], text[i:j]))
                        case = 0 if not upper else 1 if upper == j - i or (upper == 1 and value[i].isupper()) else upper + 1
                        bits = math.log2(rank) + case + leet + back
                        least = bits if least is None else min(least, bits)
            if least is not None:
                out.append((i, j, least, "word"))
    for m in _DATES.finditer(value):
        apart = any(c in "-/._" for c in m[1])
        out.append((m.start(), m.start() + len(m[1]), math.log2(365 * 130) + 2 * apart, "date"))
    for m in _YEAR.finditer(value):
        out.append((m.start(), m.start() + 4, math.log2(130), "date"))
    return out


def pieces(value: str, words: Dictionary = BASIC) -> list[tuple[int, int, float, str]]:
    """(start, end, bits, kind) of every word, date, repeat and walk in a value, parts of repeats and walks included."""
    n, out = len(value), _listed(value, words)
    each = char_bits(value)
    for p in range(1, n // 2 + 1):
        run = 0  # equal characters p apart, up to here
        for e in range(p + 1, n + 1):
            run = run + 1 if value[e - 1] == value[e - 1 - p] else 0
            for times in range(2, run // p + 2):
                if times * p >= 3:
                    out.append((e - times * p, e, p * each + math.log2(times), "repeat"))
    for i in range(n):
        turns, step, shifted = 0, None, value[i] in _SHIFT
        for j in range(i + 1, n):
            s = _adjacent(value[j - 1], value[j])
            if s is None:
                break
            turns += s != step
            step = s
            shifted += value[j] in _SHIFT
            if j - i >= 2:
                out.append((i, j + 1, _STARTS + turns * _DEGREE + math.log2(j - i + 1) + (0 if not shifted else 1 if shifted == j - i + 1 else 2), "walk"))
    return out


def _runs(value: str) -> list[tuple[int, int, int]]:
    """(period, start, end) of the longest spans that repeat, of whatever period; a multiple of a period
    that holds in all of the span is left out, as it never costs less."""
    v = np.array([ord(c) for c in value], np.uint32)
    out: list[tuple[int, int, int]] = []
    for p in range(1, len(v) // 2 + 1):
        stop = np.r_[-1, np.flatnonzero(v[p:] != v[:-p]), len(v) - p]
        for k in np.flatnonzero(np.diff(stop) - 1 >= p):
            a, z = int(stop[k]) + 1, int(stop[k + 1]) + p
            if not any(p % q == 0 and b <= a and z <= y for q, b, y in out):
                out.append((p, a, z))
    return out


def guess_cost(value: str, words: Dictionary = BASIC) -> tuple[float, list[tuple[str, int, int]]]:
    """(bits, [(kind, start, end)]): the cheapest segmentation. An empty value costs nothing."""
    n = len(value)
    each = char_bits(value)
    ends: dict[int, list[tuple[int, float, str]]] = {}
    for s, e, bits, kind in _listed(value, words):
        ends.setdefault(e, []).append((s, bits, kind))
    repeats: dict[int, list[tuple[int, int]]] = {}
    for p, a, z in _runs(value):
        for e in range(a + max(2 * p, 3), z + 1):
            repeats.setdefault(e, []).append((p, a))
    # turns[j]: changes of step up to character j; walk: where the walk that holds the last character starts
    steps = [None, *(_adjacent(a, b) for a, b in zip(value, value[1:]))]
    turns = np.cumsum([0, *(a != b for a, b in zip(steps, steps[1:]))])
    shifts = np.cumsum([0, *(c in _SHIFT for c in value)])
    walk = 0
    logs, least = np.log2(np.arange(1, n + 2)), np.zeros(n + 1)
    # best[k]: least cost of the first k characters; brute[k]: of those whose last piece is brute force
    best, brute = [0.0] * (n + 1), [math.inf] * (n + 1)
    came: list[tuple[int, str]] = [(0, "")] * (n + 1)
    since = [0] * (n + 1)
    for k in range(1, n + 1):
        go_on, begin = brute[k - 1] + each, best[k - 1] + PIECE_BITS + each
        brute[k], since[k] = (go_on, since[k - 1]) if go_on <= begin else (begin, k - 1)
        best[k], came[k] = brute[k], (since[k], "brute")
        for s, bits, kind in ends.get(k, ()):
            if best[s] + PIECE_BITS + bits < best[k]:
                best[k], came[k] = best[s] + PIECE_BITS + bits, (s, kind)
        for p, a in repeats.get(k, ()):
            least_times = 2 if p > 1 else 3
            at = np.arange(k - least_times * p, a - 1, -p)
            costs = least[at] + PIECE_BITS + p * each + logs[least_times - 1 : least_times - 1 + len(at)]
            i = int(np.argmin(costs))
            if costs[i] < best[k]:
                best[k], came[k] = float(costs[i]), (int(at[i]), "repeat")
        walk = k - 1 if steps[k - 1] is None else walk
        if k - walk >= 3:
            at = np.arange(walk, k - 2)
            upper = shifts[k] - shifts[at]
            costs = least[at] + PIECE_BITS + _STARTS + (1 + turns[k - 1] - turns[at + 1]) * _DEGREE + logs[k - at - 1] + np.where(upper == 0, 0, np.where(upper == k - at, 1, 2))
            i = int(np.argmin(costs))
            if costs[i] < best[k]:
                best[k], came[k] = float(costs[i]), (int(at[i]), "walk")
        least[k] = best[k]
    out, k = [], n
    while k > 0:
        s, kind = came[k]
        out.append((kind, s, k))
        k = s
    return best[n], out[::-1]


def credentials(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of every value in a credential's context, in order."""
    found, floor = [], 0
    for m in _CONTEXT.finditer(text):
        g = next(i for i in (1, 2, 3) if m[i] is not None)
        s, e = m.span(g)
        if g == 3:
            while e > s and text[e - 1] in ".,;:)]}":
                e -= 1
        if e > s:
            at = m.start()
            while at > floor and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in "_.-"):
                at -= 1
            name = text[at : m.start()] + _IDENT.match(text, m.start(), m.end())[0]
            floor = e  # no letter is looked at twice
            found.append((name.strip(".-"), s, e))
    found += [("url", *m.span(2)) for m in _URL.finditer(text)]
    last = -1
    for name, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= last:
            yield name, s, e
            last = e


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = SECRET_BITS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, name, start, length, shown, cost_bits, pieces, secret): a row for each value in a
    credential's context, in whatever order.

    ``start`` and ``length`` count characters; ``shown`` is the value's first four characters,
    so that results don't spread secrets; ``secret`` says that the cost reaches ``bits``. Rows
    without id or text have none, nor has an empty text or table; repeated rows repeat theirs; extra columns are ignored.
    Values and texts may be of any length. Of values that overlap the one that begins first counts, and of those that begin
    together the longest. What isn't UTF-8 counts as U+FFFD.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))  # of the file's size
    d = texts(docs, id_col, text_col).where(F.col("text").rlike(PREFILTER))
    names = ["doc_id", "name", "start", "length", "shown", "cost_bits", "pieces", "secret"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        for batch in batches:
            for part in V.slices(batch):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), V.valid(part.column(1)).to_pylist()):
                    for name, s, e in credentials(text):
                        cost, cut = guess_cost(text[s:e], words)
                        rows.append((doc_id, name, s, e - s, text[s : s + min(4, (e - s) // 2)], round(cost, 6), " ".join(f"{k}:{b - a}" for k, a, b in cut), cost >= bits))
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return d.mapInArrow(run, "doc_id long, name string, start long, length long, shown string, cost_bits double, pieces string, secret boolean")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
