"""Quality classifier by weak supervision.

1. *Labellers.* Overlapping heuristics look at every document and vote bad (1), good (0) or
   abstain (-1): one set for quality, one for toxicity. Where the ``labels`` table covers a
   document, its annotator is one more labeller (of ``ANNOTATED`` of 100 ids, by a hash of the id: all of them,
   unless some are to stay unseen, for held-out accuracy). No word is named here: the two word
   lists that vote on toxicity are learned from annotated documents, each from one half of at most ``LEARN`` of them, and
   a list doesn't vote on annotated documents of its own half.
2. *Label model.* The votes of all documents are counted by pattern. Expectation-maximisation
   over the pattern counts gives each labeller's accuracy on either class, and the
   posterior of each pattern.
3. *Scorer.* On a bounded sample (``SAMPLE`` documents, the least by a hash of the id, and as
   many again of each kind of bad document) a logistic scorer is trained against the
   posteriors over hashed features: words, word beginnings and bucketed shape statistics.
4. Every document gets two probabilities; ``keep`` is whether both are under ``REJECT``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import cut, table, texts

#: Documents of the training sample, of each stratum; hash buckets; share of ids whose annotation is used, in 100.
SAMPLE, DIM, ANNOTATED = 4000, 1 << 18, 100
#: Annotated documents from which the word lists are learned, at most.
LEARN = 12_000
#: Places of a listed word that are in toxic documents, as a share of all of its; words of a list at most.
PURITY, LISTED = 0.8, 20_000
#: Ranges of the words' hash, each learned by a task of its own.
RANGES = 8
#: On a text of fewer words the heuristics abstain; words of a window in which distinct words are counted.
FEW, WINDOW = 5, 100
#: Probability of being bad from which a document is rejected.
REJECT = 0.5
#: Weight of a shape statistic against a word of a text of 100 features.
SHAPE_VALUE = 4.0
SHAPES = ("upper", "marks", "loose", "repeat", "distinct", "lines", "length", "digits")
QUALITY = ("upper", "marks", "loose", "repeat", "distinct", "lines", "annotator_q")
TOXIC = ("list_a", "list_b", "annotator_t")
#: A list says good only where it knows this share of a text's distinct words from its own documents.
FAMILIAR = 0.3


def _class_table(test) -> np.ndarray:
    return np.array([b < 128 and test(chr(b)) for b in range(256)])


_UPPER, _LOWER, _DIGIT = _class_table(str.isupper), _class_table(str.islower), _class_table(str.isdigit)
_ODD = _class_table(lambda c: c in "!#$%&*|<>{}[]\\^~=+_@/")
_ALNUM = _class_table(str.isalnum) | (np.arange(256) >= 128)
_NEWLINE = np.arange(256) == 10


class Lists:
    """Two word lists, as sorted hashes: words of toxic documents, and all words that their documents hold."""

    def __init__(self, toxic: list[np.ndarray] | None = None, heard: list[np.ndarray] | None = None):
        none = [np.empty(0, np.uint64)] * 2
        self.toxic, self.heard = toxic or none, heard or none


def _held(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def places(words: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hash of it and the word before it in its text)."""
    h = words.hash
    before = np.r_[np.uint64(0), h[:-1]][: len(h)]
    before[words.first[:-1][np.diff(words.first) > 0]] = 0
    return h, V.mix(h ^ V.mix(before + np.uint64(1)))


def word_list(h: np.ndarray, place: np.ndarray, toxic: np.ndarray, share: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words that tell toxic texts, hashes of all words), both sorted, from ``places`` and whether each lies in a toxic text.

    A word counts once behind each different word, so that copies of one text count once. It is listed if it has so many
    such places in toxic texts that, were they dealt out by chance, no word would have them there. What is given are
    the words of one of ``share`` ranges of the hash.
    """
    found = []
    for here in (toxic, ~toxic):
        _, first = np.unique(place[here], return_index=True)
        found.append(np.unique(h[here][first], return_counts=True))
    (bad, n), (good, other) = found
    at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
    in_clean = np.where(good[at] == bad, other[at], 0) if len(good) else np.zeros(len(bad), np.int64)
    base = max(1e-9, min(0.5, n.sum() / max(1, n.sum() + other.sum())))
    least = np.log(2 * max(2, share * len(bad))) / np.log(1 / base)
    listed = np.flatnonzero((n >= least) & (n >= PURITY * (n + in_clean)))
    if len(listed) > LISTED // share:
        listed = np.sort(listed[np.argsort(-n[listed], kind="stable")[: LISTED // share]])
    return bad[listed], np.union1d(bad, good)


class Shapes:
    """Per-text shape statistics of a column of texts, and its folded words."""

    def __init__(self, col: pa.Array, lists: Lists | None = None):
        col = pc.fill_null(V.valid(col), "")
        raw, off = V.buffer_of(col)
        n = len(off) - 1
        self.bytes = np.diff(off)

        def share(mask: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(mask)])
            num = (c[off[1:]] - c[off[:-1]]).astype(float)
            if of is None:
                return num
            return num / np.maximum(1, of)

        letters = share(_UPPER[raw] | _LOWER[raw])
        start, end, first = V.word_spans(raw, off)
        words = np.diff(first)
        prefix = V.Prefix(raw)
        h = prefix(start, end)
        doc = np.repeat(np.arange(n), words)
        solid = np.concatenate([[0], np.cumsum(_ALNUM[raw])])
        loose = (solid[end] == solid[start]).astype(float)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        per = lambda x: np.bincount(doc, x, n) / np.maximum(1, words)
        # lines that occurred before in the same text
        cut_at = np.unique(np.concatenate([off, np.flatnonzero(_NEWLINE[raw]) + 1]))
        ls, le = cut_at[:-1], cut_at[1:]
        lh, ld = prefix(ls, le), np.searchsorted(off, ls, "right") - 1
        long = (le - ls) > 20
        key = np.stack([ld[long].astype(np.uint64), lh[long]], 1) if long.any() else np.empty((0, 2), np.uint64)
        lines, kinds = np.bincount(ld[long], minlength=n)[:n], np.zeros(n)
        if len(key):
            kinds = np.bincount(np.unique(key, axis=0)[:, 0].astype(np.int64), minlength=n)[:n]
        self.words = V.Words(col)
        wd = self.words.doc
        # distinct (text, word), by text: its number in the high bits, the hash in the others
        bits = np.uint64(max(1, int(n).bit_length()))
        key = (wd.astype(np.uint64) << (np.uint64(64) - bits)) | (self.words.hash >> bits)
        order = np.argsort(key)
        sk = key[order]
        new = np.ones(len(sk), bool)
        new[1:] = sk[1:] != sk[:-1]
        self.uniq = order[new]
        total = np.diff(self.words.first)
        self.n = n
        self.total = total
        self.stat = {
            "upper": share(_UPPER[raw], letters),
            "marks": share(_ODD[raw], self.bytes),
            "loose": per(loose),
            "repeat": per(again),
            "distinct": self._distinct(wd, total),
            "lines": 1 - kinds / np.maximum(1, lines),
            "length": self.bytes / np.maximum(1, words),
            "digits": share(_DIGIT[raw], self.bytes),
        }
        uh, ud = self.words.hash[self.uniq], wd[self.uniq]
        kinds = np.bincount(ud, minlength=n)[:n]
        per_text = lambda mask: np.bincount(ud[mask], minlength=n)[:n]
        lists = lists or Lists()
        self.listed = [per_text(_held(x, uh)) for x in lists.toxic]
        self.familiar = [per_text(_held(x, uh)) / np.maximum(1, kinds) if len(x) else np.zeros(n) for x in lists.heard]

    def _distinct(self, doc: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Share of distinct words in windows of WINDOW words, over all windows of a text, so that it means the same at any length.

        A last window that isn't full counts with the one before it.
        """
        windows = np.maximum(1, total // WINDOW)
        base = np.cumsum(windows) - windows
        inside = np.arange(len(doc)) - self.words.first[doc]
        window = base[doc] + np.minimum(inside // WINDOW, windows[doc] - 1)
        bits = np.uint64(max(1, int(windows.sum()).bit_length()))
        key = np.sort((window.astype(np.uint64) << (np.uint64(64) - bits)) | (self.words.hash >> bits))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        found = np.bincount((key[new] >> (np.uint64(64) - bits)).astype(np.int64), minlength=int(windows.sum()))
        return np.add.reduceat(found, base) / np.maximum(1, total) if len(base) else np.empty(0)

    def votes(self) -> np.ndarray:
        """``n x 8`` votes of the heuristics, in the order of QUALITY and TOXIC without annotators."""
        s, some = self.stat, self.total >= FEW

        def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
            return np.where(~some, -1, np.where(bad, 1, np.where(good, 0, -1)))

        tox = lambda hit, familiar: np.where(hit > 0, 1, np.where(familiar >= FAMILIAR, 0, -1))
        return np.stack(
            [
                vote(s["upper"] > 0.5, s["upper"] < 0.2),
                vote(s["marks"] > 0.06, s["marks"] < 0.03),
                vote(s["loose"] > 0.2, s["loose"] < 0.05),
                vote(s["repeat"] > 0.2, s["repeat"] < 0.05),
                vote(s["distinct"] < 0.2, s["distinct"] > 0.35),
                vote(s["lines"] > 0.4, s["lines"] < 0.1),
                tox(self.listed[0], self.familiar[0]),
                tox(self.listed[1], self.familiar[1]),
            ],
            1,
        ).astype(np.int8)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash bucket, value) of every distinct feature of each text, sorted by text.

        The words' values get smaller as their number grows; a shape's value is SHAPE_VALUE.
        """
        w, u = self.words, self.uniq
        doc, start, end = w.doc[u], w.start[u], w.end[u]
        parts, owners = [w.hash[u]], [doc]
        for size in (4, 5, 6):
            long = end - start > size
            parts.append(w.prefix(start[long], start[long] + size) + np.uint64(size))
            owners.append(doc[long])
        for i, name in enumerate(SHAPES):
            level = np.minimum(31, (np.sqrt(np.maximum(0, self.stat[name])) * (4 if name == "length" else 20)).astype(np.int64))
            parts.append(V.mix((level + 1000 * (i + 1)).astype(np.uint64)))
            owners.append(np.arange(self.n))
        f = (V.mix(np.concatenate(parts)) & np.uint64(DIM - 1)).astype(np.int64)
        o = np.concatenate(owners)
        words = len(f) - len(SHAPES) * self.n
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(o[:words], minlength=self.n)) / 100)
        value = np.concatenate([scale[o[:words]], np.full(len(SHAPES) * self.n, SHAPE_VALUE)])
        order = np.argsort(o, kind="stable")
        return o[order], f[order], value[order]


def vote_rows(docs: DataFrame, lists: Lists | None = None) -> DataFrame:
    """(doc_id, v0 .. v7): votes of the heuristics for documents given as doc_id and text."""
    shipped = docs.sparkSession.sparkContext.broadcast(lists or Lists())  # of what LEARN documents hold
    names = [f"v{i}" for i in range(len(QUALITY) + len(TOXIC) - 2)]

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch):
                v = Shapes(part.column(1), shipped.value).votes()
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(v[:, i].astype(np.int32)) for i in range(v.shape[1])], ["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} int" for x in names))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, trusted: int = -1, silence: bool = True, rounds: int = 100, kinds: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of bad for each pattern, p[labeller, class, vote + 1], prior of bad) by EM.

    Given the class, labellers vote independently; each has its own odds of voting bad or good
    or abstaining on either class. To begin with a vote for bad is strong evidence,
    one for good weak, and labeller ``trusted`` seldom errs. Every odds keeps a little weight,
    so that no labeller becomes certain. Without ``silence`` an abstention says nothing: for
    labellers that abstain where they can't judge.

    With ``kinds``, labellers detect different kinds of bad: bad texts are a class for each labeller, on which it begins as
    the one that notices, so that a detector of one kind isn't taken for a poor one, nor its silence on others for praise.
    Their posteriors are added up, and ``p`` and the prior are those of all bad classes together.
    """
    m = patterns.shape[1]
    good, weak, strong = [0.3, 0.68, 0.02], [0.25, 0.6, 0.15], [0.3, 0.4, 0.3]
    bad = m if kinds else 1
    p = np.tile(np.array([good] + [weak if kinds else strong] * bad), (m, 1, 1))
    if kinds:
        p[np.arange(m), np.arange(m) + 1] = [0.1, 0.1, 0.8]
    p[trusted] = [[0.5, 0.498, 0.002]] + [[0.5, 0.002, 0.498]] * bad
    prior = np.array([0.9] + [0.1 / bad] * bad)
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    if not silence:
        hot[:, :, 0] = 0
        p[:, :, 0] = 0
        p /= p.sum(2, keepdims=True)
    post = np.tile(prior, (len(patterns), 1))
    for _ in range(rounds):
        ll = np.einsum("nmv,mcv->nc", hot, np.log(np.maximum(p, 1e-12))) + np.log(prior)
        post = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -500))
        post /= post.sum(1, keepdims=True)
        w = counts[:, None] * post
        n = np.einsum("nc,nmv->mcv", w, hot) + np.array([0.5 * silence, 0.5, 0.5])
        p = n / n.sum(2, keepdims=True)
        prior = w.sum(0) + np.array([9] + [1 / bad] * bad)
        prior = np.maximum(prior / prior.sum(), 1e-6)
    share = prior[1:] / prior[1:].sum()
    return 1 - post[:, 0], np.stack([p[:, 0], np.einsum("mcv,c->mv", p[:, 1:], share)], 1), float(1 - prior[0])


def train_scorer(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, **kw) -> np.ndarray:
    """``fit_scorer`` over the features of all texts in one column, in order of the text."""
    first = np.searchsorted(doc, np.arange(len(target) + 1))

    def take(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(first)[batch]
        at = np.repeat(first[batch] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return size, feature[at], value[at]

    return fit_scorer(take, target, **kw)


def values_of(size: np.ndarray) -> np.ndarray:
    """The values of the features of texts that have so many each, as ``Shapes.features`` gives them: words, then shapes."""
    words = size - len(SHAPES)
    x = np.repeat((1 / np.sqrt(np.maximum(1, words) / 100)).astype(np.float32), size)
    x[(np.cumsum(size)[:, None] - 1 - np.arange(len(SHAPES))).ravel()] = SHAPE_VALUE
    return x


def fit_scorer(take: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 0.15, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression by AdaGrad in small batches; weights of DIM + 1 (the last: bias).

    ``take`` gives (number of features of each, features, values) of the texts of one batch, so no more than a batch is copied.
    """
    n = len(target)
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 0.1)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 64)):
            size, f, x = take(batch)
            own = np.repeat(np.arange(len(batch)), size)
            z = np.bincount(own, w[f] * x, len(batch)) + w[DIM]
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[batch]
            uf, inv = np.unique(f, return_inverse=True)
            g = np.bincount(inv, err[own] * x, len(uf)) / len(batch) + l2 * w[uf]
            g2[uf] += g * g
            w[uf] -= rate * g / np.sqrt(g2[uf])
            gb = err.mean()
            g2[DIM] += gb * gb
            w[DIM] -= rate * gb / np.sqrt(g2[DIM])
    return w.astype(np.float32)


def taken(features: list[np.ndarray], order: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``fit_scorer``, of texts whose features lie apart: those of number ``order[i]`` for each ``i`` of the batch."""
    own = [features[i] for i in order[batch]]
    size = np.array([len(f) for f in own])
    return size, np.concatenate(own), values_of(size)


def score(shapes: Shapes, weights: list[np.ndarray]) -> list[np.ndarray]:
    doc, f, x = shapes.features()
    return [1 / (1 + np.exp(-np.clip(np.bincount(doc, w[f] * x, shapes.n) + w[DIM], -30, 30))) for w in weights]


def learn_lists(d: DataFrame, annotated: DataFrame) -> Lists:
    """The word lists of both halves of at most ``LEARN`` annotated documents, the least by a hash of the id."""
    chosen = annotated.where("at in (0, 1)").orderBy(F.xxhash64("doc_id", F.lit(11))).limit(LEARN).select("doc_id", "at", "half")
    picked = d.join(F.broadcast(chosen), "doc_id").select("half", "at", "text")  # at most LEARN rows

    @V.tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch):
                w = V.Words(part.column(2))
                h, place = places(w)
                half, bad = (part.column(i).to_numpy()[w.doc] for i in (0, 1))
                group = (half * RANGES + V.bucket(h, RANGES)).astype(np.int32)
                rows = [(g, h[at].tobytes(), place[at].tobytes(), (bad[at] == 1).tobytes()) for g, at in V.split(group)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["group", "h", "place", "bad"])

    def learn(t: pa.Table) -> pa.Table:
        arrays = [np.concatenate([np.frombuffer(x, kind) for x in t[name].to_pylist()]) for name, kind in (("h", np.uint64), ("place", np.uint64), ("bad", bool))]
        listed, heard = word_list(*arrays, share=RANGES)
        return pa.table({"group": t["group"].slice(0, 1), "listed": pa.array([listed.tobytes()], pa.binary()), "heard": pa.array([heard.tobytes()], pa.binary())})

    rows = picked.mapInArrow(pack, "group int, h binary, place binary, bad binary").groupBy("group").applyInArrow(learn, "group int, listed binary, heard binary").orderBy("group").collect()
    # ranges of the hash in their order, so the lists are in order too
    of = lambda half, name: np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r[name], np.uint64) for r in rows if r.group // RANGES == half)])
    return Lists([of(0, "listed"), of(1, "listed")], [of(0, "heard"), of(1, "heard")])


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, annotated: int = ANNOTATED) -> tuple[list[np.ndarray], dict]:
    """Weights of the two scorers and the label model's estimates.

    ``labels`` (doc_id, quality 0/1, toxic 0/1) may be None or empty; nulls in it abstain.
    """
    spark = docs.sparkSession
    d = texts(docs, id_col, text_col)
    lists = Lists()
    if labels is not None:
        a = labels.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(100)) < annotated)
        a = a.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("aq"), F.max("toxic").cast("int").alias("at"))
        a = cut(a.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")))
        lists = learn_lists(d, a)
        votes = vote_rows(d, lists).join(a, "doc_id", "left")
        # a list has seen the annotated documents of its half
        votes = votes.withColumns({c: F.when(F.col("half") == i, -1).otherwise(F.col(c)) for i, c in enumerate(("v6", "v7"))})
    else:
        votes = vote_rows(d).withColumns({"aq": F.lit(None).cast("int"), "at": F.lit(None).cast("int")})
    votes = votes.withColumns({c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(-1) for c in ("aq", "at")})
    votes = cut(votes)
    q_cols, t_cols = [f"v{i}" for i in range(6)] + ["aq"], [f"v{i}" for i in range(6, 8)] + ["at"]
    model, post = {}, {}
    for kind, cols in (("quality", q_cols), ("toxic", t_cols)):
        rows = votes.groupBy(*cols).count().collect()  # at most 3 ** 7 patterns
        rows = sorted(rows, key=lambda r: tuple(r[:-1]))
        p = np.array([tuple(r)[:-1] for r in rows], np.int8).reshape(-1, len(cols))
        c = np.array([r[-1] for r in rows], float)
        said = (p >= 0).any(1)  # documents on which all abstain teach nothing
        p, c = p[said], c[said]
        model[kind] = fit_label_model(p, c, silence=kind == "quality", kinds=kind == "quality")
        # as Arrow: of a list Spark makes rows in Python workers of another kind, which stay beside the others
        post[kind] = spark.createDataFrame(pa.table({c: pa.array(p[:, i].astype(np.int32)) for i, c in enumerate(cols)} | {f"p_{kind}": pa.array(model[kind][0].astype(float))}))
    pq, pt = post["quality"], post["toxic"]
    labelled = votes.join(F.broadcast(pq), q_cols, "left").join(F.broadcast(pt), t_cols, "left")  # at most 3 ** 7 rows each
    h = F.xxhash64("doc_id", F.lit(3))
    # where every labeller of a kind abstains there is no target
    rows = labelled.select("doc_id", h.alias("h"), F.coalesce("p_quality", F.lit(-1.0)).alias("tq"), F.coalesce("p_toxic", F.lit(-1.0)).alias("tt"))
    chosen = rows.orderBy("h").limit(sample)
    for cond in ("tq > 0.5", "tt > 0.5", "tt between 0 and 0.5"):
        chosen = chosen.union(rows.where(cond).orderBy("h").limit(sample))
    chosen = cut(chosen.dropDuplicates(["doc_id"]))
    picked = d.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "tq", "tt")  # at most 4 * sample rows

    @V.tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch):
                s = Shapes(part.column(1))
                doc, f, _ = s.features()  # the values follow from how many there are
                at = 4 * np.r_[0, np.cumsum(np.bincount(doc, minlength=s.n))]
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), s.n, [None, pa.py_buffer(at), pa.py_buffer(f.astype(np.int32))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), packed], ["doc_id", "tq", "tt", "f"])

    # with nothing to learn from, nothing is rejected
    none = np.zeros(DIM + 1, np.float32)
    none[DIM] = -10

    @V.tidy
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("tq", pa.float64()), ("tt", pa.float64()), ("f", pa.binary())]))
        f = [np.frombuffer(x.as_buffer(), np.int32) for x in t["f"]]  # where they came in, without a copy
        order = np.argsort(t["doc_id"].to_numpy(), kind="stable")
        out = []
        for name in ("tq", "tt"):
            y = t[name].to_numpy()[order]
            out.append(fit_scorer(functools.partial(taken, f, order[y >= 0]), y[y >= 0]).tobytes() if (y >= 0).any() else none.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(out, pa.binary())], ["head", "w"])

    rows = picked.mapInArrow(features, "doc_id long, tq double, tt double, f binary").repartition(1).mapInArrow(train, "head long, w binary").collect()
    w = {r.head: np.frombuffer(r.w, np.float32) for r in rows}
    return [w.get(0, none), w.get(1, none)], model


def classify(docs: DataFrame, weights: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """(doc_id, p_bad, p_toxic, keep) for every row, in whatever order.

    A row without text, or with a text without words, has nothing to be judged by: null
    probabilities, and it is kept. Every other text is judged whole, however short or long. Repeated rows and rows
    without id have a row each; extra columns are ignored; an empty table gives no rows; what isn't UTF-8 counts as U+FFFD.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch):
                s = Shapes(part.column(1))
                q, t = score(s, weights)
                blank = s.total == 0
                keep = blank | (q < reject) & (t < reject)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(q, mask=blank), pa.array(t, mask=blank), pa.array(keep)], ["doc_id", "p_bad", "p_toxic", "keep"])

    return d.mapInArrow(run, "doc_id long, p_bad double, p_toxic double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame | None, **kw) -> DataFrame:
    """Fits on ``docs`` and ``labels`` and classifies all of ``docs``: see ``classify``."""
    weights, _ = fit(docs, labels, **kw)
    return classify(docs, weights, kw.get("id_col", "doc_id"), kw.get("text_col", "text"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, for quality or toxicity, go.

    A rejected text takes along every row with that text and nothing else: the decision is a
    function of the text alone. Rows without id are judged as any other; those without text or words stay; an empty table stays
    empty, and with nothing to learn from nothing is rejected. The columns are those of ``docs``, whatever their names.
    """
    weights, _ = fit(docs, table(spark, sf_dir, "labels"))
    text = docs.schema.fieldNames().index("text")

    @V.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch, batch.schema.names[text]):
                s = Shapes(part.column(text))
                q, t = score(s, weights)
                yield part.filter(pa.array((s.total == 0) | (q < REJECT) & (t < REJECT)))

    return docs.mapInArrow(run, docs.schema)
