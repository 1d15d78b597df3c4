import random

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import cuckoo, decontam, minhash, substring, vectext

DOCS = "doc_id long, text string, sig string, keep_id int, digest string"


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(3)


def pairs(df):
    return sorted(map(tuple, df.collect()))


ODD = [(None, "some text"), (None, None), (50, None), (51, ""), (52, ""), (53, "   \n"), (54, "a"), (55, "a"), (55, "a"), (56, "é" * 3000)]


# words


def test_words_are_split_and_hashed_alike(spark):
    texts = ["Ab c,d", "", "  x ", None, "ab C d", "x", "né né"]
    w = vectext.Words(pa.array(texts))
    got = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
    assert got[0] == got[4] and got[2] == got[5] and got[1] == got[3] == [] and got[6][0] == got[6][1]
    raw = [bytes(w.raw[s:e]) for s, e in zip(w.start, w.end)]
    assert raw[:3] == [b"ab", b"c", b"d"]
    h = vectext.window_hash(w.hash, 2)
    assert h[0] == h[4] and h[1] == h[5]  # the same two words, wherever they are


def test_planes():
    a = np.array([5, 5, 7, -3, 1 << 40])
    assert vectext.unplanes(vectext.planes(a)).tolist() == a.tolist()
    assert vectext.unplanes(vectext.planes(a[:0])).tolist() == []


# exact


def brute_exact(rows):
    least = {}
    for i, t in rows:
        if i is not None and t is not None:
            least[t] = min(i, least.get(t, i))
    return sorted({(i, least[t]) for i, t in rows if i is not None and t is not None and i != least[t]})


def test_exact_duplicates(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefgh") * rng.randrange(1, 4)) for i in range(300)] + ODD
    assert pairs(cuckoo.exact_duplicates(frame(spark, rows))) == brute_exact(rows)
    assert pairs(cuckoo.exact_duplicates(frame(spark, []))) == []


def test_exact_stage_keeps_one_of_each(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (4, "c"), (5, None), (None, "a"), (None, "a")]
    left = cuckoo.stage_exact_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id and r.text) == [(1, "a"), (2, "b"), (4, "c")]
    assert len(left) == 6 and left[0].__fields__ == ["doc_id", "text", "sig", "keep_id", "digest"]
    plain = [(1, "a"), (2, "a"), (3, "b")]
    assert sorted(r.doc_id for r in cuckoo.stage_exact_dedup(spark, frame(spark, plain), "").collect()) == [1, 3]


def test_exact_odd_columns(spark):
    """Columns that are named like our own, equal digests of different texts, many copies, very long texts."""
    long = "é" * 400_000
    rows = [(i, "same") for i in range(3000)] + [(4000 + i, long) for i in range(3)] + [(5000, "one"), (5000, "one")]
    docs = frame(spark, rows).withColumnsRenamed({"sig": "__digest", "keep_id": "i", "digest": "d"}).selectExpr("*", "1 as t")
    left = cuckoo.stage_exact_dedup(spark, docs, "")
    assert left.columns == docs.columns and sorted((r.doc_id, r["__digest"], r.i, r.d, r.t) for r in left.collect()) == [(i, "x", 1, "y", 1) for i in (0, 4000, 5000)]
    assert cuckoo.stage_exact_dedup(spark, docs.limit(0), "").count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "digests", lambda d, i="doc_id", t="text": cuckoo.texts(d, i, t).selectExpr("*", "cast(length(text) as long) as digest"))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc"), (6, "ddd"), (7, "ddd"), (5, "cc"), (8, "e")]
    assert pairs(cuckoo.exact_duplicates(frame(spark, rows))) == [(3, 1), (4, 2), (7, 6)]
    ix = cuckoo.apply_changes(None, frame(spark, rows[:2]), buckets=4)
    assert pairs(cuckoo.probe(ix, frame(spark, [(9, "bb"), (10, "xx")]), buckets=4)) == [(9, 2)]


def test_cuckoo_index_holds_deletes_and_grows():
    rng = np.random.default_rng(2)
    ix, live = cuckoo.CuckooIndex(2), {}
    for step in range(300):
        d = rng.integers(0, 1500, 30) * 7919 - (1 << 62)
        if step % 5 < 3:
            hits = ix.insert(d)
            twice = {x for x in d.tolist() if x in live or d.tolist().count(x) > 1}
            assert twice <= set(hits.tolist()) <= set(d.tolist())
            for x in d.tolist():
                live[x] = live.get(x, 0) + 1
        else:
            want = 0
            for x in d.tolist():
                if live.get(x):
                    live[x] -= 1
                    want += 1
                    if not live[x]:
                        del live[x]
            assert ix.delete(d) == want
        assert dict(zip(ix.keys.tolist(), ix.counts.tolist())) == live and ix.filter.size == len(live)
        assert ix.filter.contains(ix.keys).all()
    assert ix.resizes > 3
    unseen = rng.integers(0, 1 << 62, 20_000)
    assert ix.filter.contains(unseen).mean() < 0.001
    again = cuckoo.CuckooIndex.loads(ix.dumps())
    assert again.keys.tolist() == ix.keys.tolist() and again.filter.contains(ix.keys).all() and again.insert(ix.keys[:5]).tolist() == ix.keys[:5].tolist()


def test_many_copies_take_linear_time():
    import time

    took = []
    for n in (50_000, 400_000):
        ix, t = cuckoo.CuckooIndex(), time.process_time()
        for at in range(0, n, 10_000):
            ix.insert(np.full(10_000, 5))
        ix.delete(np.full(n, 5))
        took.append(time.process_time() - t)
        assert not len(ix.keys) and not ix.filter.size
    assert took[1] < 20 * took[0] + 0.5


def test_index_tables(spark):
    rows = [(i, f"t{i % 10}") for i in range(30)] + [(7, "t7"), (None, "t1"), (40, None)]
    docs = frame(spark, rows)
    ix = cuckoo.apply_changes(None, docs, buckets=4)
    assert ix.filters.selectExpr("sum(live)", "sum(digests)").first()[:] == (31, 10)
    ix = cuckoo.apply_changes(ix, None, docs.where("doc_id < 20 or doc_id % 10 = 3"), buckets=4)
    asked = frame(spark, [(100 + i, f"t{i}") for i in range(10)] + [(100, "t0"), (None, "t1"), (101, None)])
    assert pairs(cuckoo.probe(ix, asked, buckets=4)) == [(100 + i, 20 + i) for i in range(10) if i != 3]
    ix = cuckoo.apply_changes(ix, frame(spark, [(3, "t3")]), frame(spark, [(999, "t5")]), buckets=4)
    assert dict(pairs(cuckoo.probe(ix, asked, buckets=4)))[103] == 3
    assert cuckoo.probe(cuckoo.apply_changes(None, docs.limit(0)), asked).count() == 0
    with pytest.raises(ValueError):
        cuckoo.apply_changes(None, None)


# near


def brute_groups(ids, sig, t):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (sig[a] == sig[b]).sum() >= t:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return sorted((i, find(i)) for i in ids if find(i) != i)


def test_near_groups_equal_those_of_all_pairs(spark):
    rng = random.Random(3)
    rows, common = [], [words(rng, 12) for _ in range(5)]
    for i in range(220):
        if i % 3 and rows:
            old = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 10)):
                old[rng.randrange(len(old))] = f"n{rng.randrange(9999)}"
            rows.append((i, " ".join(old)))
        else:
            rows.append((i, " ".join(words(rng, rng.randrange(3, 60)) + rng.choice(common))))
    sig = minhash.signature_matrix(pa.array([t for _, t in rows]))
    want = brute_groups([i for i, _ in rows], sig, minhash.THRESHOLD)
    assert pairs(minhash.near_duplicates(frame(spark, rows))) == want and len(want) > 50
    rows += [(900, rows[5][1]), (901, rows[5][1])]
    sig = minhash.signature_matrix(pa.array([t for _, t in rows]))
    same = (sig[:, None, :] == sig[None, :, :]).sum(2)
    want = sorted((rows[a][0], rows[b][0], int(same[a, b])) for a in range(len(rows)) for b in range(a + 1, len(rows)) if same[a, b] >= minhash.THRESHOLD)
    assert pairs(minhash.near_pairs(frame(spark, rows))) == want


def test_links_connect_what_all_pairs_do():
    rng = np.random.default_rng(13)
    for _ in range(200):
        n, t = int(rng.integers(2, 14)), 6
        sig = rng.integers(0, 3, (n, 10)).astype(np.uint32)
        root = list(range(n))
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    if (sig[a] == sig[b]).sum() >= t:
                        root[a] = root[b] = min(root[a], root[b])
        links = minhash.link_members(sig, t)
        mine = list(range(n))
        for _ in range(n):
            for a, b, m in links:
                assert m == (sig[a] == sig[b]).sum() >= t
                mine[a] = mine[b] = min(mine[a], mine[b])
        assert mine == root


def test_near_odd_rows(spark):
    rows = ODD + [(60, "One, two three FOUR five"), (61, "one two three four five!"), (62, "quite another text than that one")]
    got = pairs(minhash.near_duplicates(frame(spark, rows)))
    assert got == [(52, 51), (53, 51), (55, 54), (61, 60)]
    assert pairs(minhash.near_duplicates(frame(spark, []))) == []
    left = minhash.stage_near_dedup(spark, frame(spark, rows), "")
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 50, 51, 54, 56, 60, 62]
    assert left.columns == ["doc_id", "text", "sig", "keep_id", "digest"]


def test_near_recall_of_true_similarity(spark):
    rng = random.Random(4)
    rows, planted = [], []
    for i in range(60):
        base = words(rng, 120, 100_000)
        rows.append((2 * i, " ".join(base)))
        for _ in range(6):
            base[rng.randrange(120)] = "edited"
        rows.append((2 * i + 1, " ".join(base)))
        planted.append((2 * i + 1, 2 * i))
    got = pairs(minhash.near_duplicates(frame(spark, rows)))
    assert len(set(got) & set(planted)) >= 0.9 * len(planted) and len(got) <= len(planted)


def test_posting_lists_come_whole_and_in_linear_time():
    import time

    rng = np.random.default_rng(23)
    pair = np.sort(np.r_[rng.integers(0, 50, 300), np.full(4000, 25), rng.integers(51, 90, 50)])
    batch = lambda p, at: pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.arange(len(p)) + at), pa.array([b"x"] * len(p))], ["pair", "rep", "sig"])
    got = []
    cuts = np.r_[0, np.sort(rng.integers(0, len(pair), 60)), len(pair)]
    for p, rep, payload, at in minhash._lists(batch(pair[a:b], a) for a, b in zip(cuts[:-1], cuts[1:])):
        assert len(payload) == len(p) == at[-1]
        got += [(int(p[a]), rep[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    assert [k for k, _ in got] == sorted(set(pair.tolist())) and [x for _, r in got for x in r] == list(range(len(pair)))
    took = []
    for n in (40_000, 400_000):  # one list
        t = time.process_time()
        assert [len(p) for p, *_ in minhash._lists(batch(np.full(2000, 7), i) for i in range(0, n, 2000))] == [n]
        took.append(time.process_time() - t)
    assert took[1] < 25 * took[0] + 0.5


def test_a_hot_pair_of_many_texts(spark):
    rng = random.Random(33)
    rows = [(i, f"every page begins with this very same line of boilerplate text {' '.join(words(rng, 25, 1 << 40))}") for i in range(8000)]
    rows += [(10_000 + i, rows[i][1] + " more") for i in range(0, 8000, 40)]
    got = pairs(minhash.near_duplicates(frame(spark, rows)))
    planted = {(10_000 + i, i) for i in range(0, 8000, 40)}
    assert len(planted & set(got)) >= 0.95 * len(planted) and len(set(got) - planted) <= 5


def test_sketch_never_loses_a_match():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 32, (50, 64), dtype=np.uint64).astype(np.uint32)
    b = np.where(rng.random((50, 64)) < 0.5, a, a + 1)
    seen = minhash.sketch_matches(minhash.sketch_of(a), minhash.sketch_of(b), 64)
    assert (seen >= (a == b).sum(1)).all() and (seen <= 64).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = pairs(minhash.components(spark.createDataFrame(edges, "a long, b long")))
    assert got == sorted(root.items())


# benchmark


def brute_overlaps(rows, items, least, share):
    found = set()
    for i, t in rows:
        for j, s in items:
            a, b = t.lower().split(), s.lower().split()
            for d in range(-len(b) + 1, len(a)):
                best = (0, 0, 0, 0)
                for lo in range(len(b)):
                    score = same = 0
                    for hi in range(lo, len(b)):
                        if not 0 <= d + hi < len(a):
                            break
                        eq = a[d + hi] == b[hi]
                        same += eq
                        score += 1 if eq else -decontam.SUBSTITUTION
                        if score > best[0]:
                            best = (score, lo, hi + 1, same)
                if best[3] >= int(decontam.least_matches(np.array([len(b)]), least, share)[0]) and best[3] >= share * (best[2] - best[1]) and best[0] > 0:
                    found.add((i, j, d + best[1], best[2] - best[1], best[3]))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    items = [(j, " ".join(words(rng, rng.randrange(14, 40), 100_000))) for j in range(6)]
    rows = []
    for i in range(40):
        t = words(rng, rng.randrange(0, 40), 50)
        if i % 2:
            p = items[rng.randrange(6)][1].split()
            for _ in range(rng.randrange(0, len(p) // 6 + 1)):
                p[rng.randrange(len(p))] = "subst"
            cut = rng.randrange(0, 5)
            t = t[:10] + p[cut:] + t[10:]
        rows.append((i, " ".join(t)))
    want = brute_overlaps(rows, items, decontam.MIN_MATCH, decontam.MIN_SHARE)
    got = set(pairs(decontam.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))))
    assert got <= want and len({x[:2] for x in got}) >= 0.9 * len({x[:2] for x in want}) and len(want) > 10


def test_any_stretch_that_satisfies_the_rule_is_found():
    rng = random.Random(17)
    hidden = found = 0
    for _ in range(400):
        n = rng.choice((8, 15, 16, 18, 50, 59))
        item = [f"w{j}" for j in range(n)]
        same = [rng.random() > rng.choice((0.2, 0.25, 0.3)) for _ in item]
        cut = rng.randrange(0, 3)  # the text begins within the item
        b = decontam.Benchmark([1], [" ".join(item)])
        w = vectext.Words(pa.array([" ".join(x if eq else "other" for x, eq in zip(item[cut:], same[cut:]))], pa.large_string()))
        part, least = same[cut:], int(decontam.least_matches(np.array([n]), decontam.MIN_MATCH, decontam.MIN_SHARE)[0])
        good = {(i, j) for i in range(len(part)) for j in range(i + 1, len(part) + 1) if (m := sum(part[i:j])) >= least and m >= decontam.MIN_SHARE * (j - i)}
        _, _, start, size, matches = b._stretch(w, np.array([[0, 0, -cut]]), decontam.MIN_MATCH, decontam.MIN_SHARE)
        assert len(start) == bool(good)
        if good:
            assert (start[0], start[0] + size[0]) in good and matches[0] == sum(part[start[0] : start[0] + size[0]])
            found += 1
            hidden += not brute_overlaps([(0, " ".join(x if eq else "other" for x, eq in zip(item[cut:], part)))], [(0, " ".join(item))], decontam.MIN_MATCH, decontam.MIN_SHARE) if n < 20 else 0
    assert found > 100 and hidden > 5  # some that the best stretch hides


def test_decontamination_odd_rows(spark, monkeypatch):
    item = "Alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(1, item), (None, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    rows = ODD + [(70, f"see: {item.upper()}!"), (71, "too short")]
    assert pairs(decontam.overlaps(frame(spark, rows), bench)) == [(70, 1, 1, 8, 8), (71, 4, 0, 2, 2)]
    assert pairs(decontam.overlaps(frame(spark, []), bench)) == []
    assert pairs(decontam.overlaps(frame(spark, rows), bench.limit(0))) == []
    # a benchmark of several passes
    monkeypatch.setattr(decontam, "PASS_WORDS", 10)
    two = spark.createDataFrame([(i, item) for i in range(4)], "item_id long, text string")
    assert [x[1] for x in pairs(decontam.overlaps(frame(spark, rows), two))] == [0, 1, 2, 3]


def test_short_items_and_their_substitutions(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "the capital of France is Paris today"), (3, "three short words"), (4, "yes"), (5, "five words are this item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "so: alpha beta gamma delta OMEGA zeta eta theta."), (2, "the capital of spain is paris today"), (3, "see three short words here"), (4, "yes!"), (5, "yes indeed, three long words"), (6, "five words are that item"), (7, "alpha beta other other other zeta eta theta"), (8, "and five words are this item too")]
    got = {x[:2] for x in pairs(decontam.overlaps(frame(spark, rows), bench))}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (8, 5)}


def test_every_allowed_substitution_of_a_short_item_leaves_a_seed():
    from itertools import combinations

    for n in range(decontam.WHOLE, decontam.SHORT):
        spare = n - int(decontam.least_matches(np.array([n]), decontam.MIN_MATCH, decontam.MIN_SHARE)[0])
        for gone in combinations(range(n), spare):
            assert any(all(c == "0" or at + j not in gone for j, c in enumerate(m)) for m in decontam.SHORT_MASKS for at in range(n - len(m) + 1)), (n, gone)


def test_a_very_long_item_and_text(spark):
    rng = random.Random(27)
    long = words(rng, 30_000, 1 << 40)
    text = long[100:]
    text[5000:5200] = ["x"] * 200
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    docs = frame(spark, [(1, " ".join(text)), (2, "nothing of it")]).selectExpr("doc_id", "text", "1 as item_id", "2 as start")
    ((doc, item, start, n, m),) = pairs(decontam.overlaps(docs, bench))
    assert (doc, item) == (1, 1) and m >= 24_000


def test_texts_that_are_not_utf8(spark):
    docs = frame(spark, [(1, "one two three four five six")]).selectExpr("doc_id", "cast(concat(cast(text as binary), X'20FF41') as string) as text", "sig")
    docs = docs.union(frame(spark, [(2, "one two three four five six")]).select("doc_id", "text", "sig"))
    assert pairs(minhash.near_duplicates(docs)) == [(2, 1)]
    bench = spark.createDataFrame([(7, "two three four five six")], "item_id long, text string")
    assert [x[:2] for x in pairs(decontam.overlaps(docs, bench))] == [(1, 7), (2, 7)]
    assert cuckoo.exact_duplicates(docs).count() == 0
    assert sorted(r.doc_id for r in minhash.stage_near_dedup(spark, docs, "").collect()) == [1]


# substrings


def brute_cover(rows, least):
    """Words of each document in a stretch that a document with a smaller id holds too, and their references."""
    first, cover = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        for p in range(len(w) - least + 1):
            ref = first.setdefault(tuple(w[p : p + least]), i)
            if ref != i:
                cover.setdefault((i, ref), set()).update(range(p, p + least))
    return cover


def test_repeats_against_brute_force(spark):
    rng = random.Random(8)
    block, least = 4, 8
    rows, passages = [], [words(rng, rng.randrange(8, 30)) for _ in range(6)]
    for i in range(60):
        t = words(rng, rng.randrange(0, 30), 40)
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) - 5)
            at = rng.randrange(0, len(t) + 1)
            t[at:at] = p[a : a + rng.randrange(4, 30)]
        rows.append((i, " ".join(t)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "same " * 40), (103, "same " * 30)]
    text = dict(rows)
    got = pairs(substring.repeats(frame(spark, rows), block=block, least=least))
    cover = brute_cover(rows, least)
    seen = {}
    for i, s, n, r, rs in got:
        a, b = text[i].split(), text[r].split()
        assert r < i and n >= least and a[s : s + n] == b[rs : rs + n]
        assert not (s and rs and a[s - 1] == b[rs - 1]) and not (s + n < len(a) and rs + n < len(b) and a[s + n] == b[rs + n])
        seen.setdefault((i, r), set()).update(range(s, s + n))
    assert set(seen) == set(cover) and all(seen[k] >= v for k, v in cover.items()) and len(cover) > 10
    for a in got:
        assert not any(a != b and a[0] == b[0] and a[3] == b[3] and b[1] <= a[1] and a[1] + a[2] <= b[1] + b[2] for b in got)


def test_repeats_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = ODD + [(80, long), (81, "x " + long + " y"), (81, "x " + long + " y"), (82, long[:100])]
    assert pairs(substring.repeats(frame(spark, rows))) == [(81, 1, 60, 80, 0)]
    assert pairs(substring.repeats(frame(spark, []))) == []
    with pytest.raises(ValueError):
        substring.repeats(frame(spark, rows), block=25, least=40)
