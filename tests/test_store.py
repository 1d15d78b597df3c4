import random

import pytest

from sedimenta.errors import BadRangeError, ClosedError, ConflictError, EmptyKeyError, EmptyValueError, ExhaustedError, KeyTooLargeError, NoSuchLevelError, NotPositionedError, OptionsError, SnapshotError, ValueTooLargeError
from sedimenta.operators.cache import ENTRY, ShardedCache
from sedimenta.operators.cursor import Cursor
from sedimenta.options import Level, Options, Sink
from sedimenta.sources import snapshots
from sedimenta.store import Table


def options(path, **kw):
    small = dict(block_size=64, run_size=200, cache_size=256, bloom_bits=64)
    return Options(str(path), kw.pop("levels", (Level(**small, max_runs=1),)), Sink(**small), key_max=16, value_max=16, **({"memtable_size": 1 << 20} | kw))


def rows(table, start=None, end=None):
    return [(bytes(r.key), bytes(r.value)) for r in table.scan(start, end).collect()]


def test_arguments(spark, tmp_path):
    t = Table(spark, options(tmp_path))
    for bad in (b"", None):
        with pytest.raises(EmptyKeyError):
            t.write(bad, b"v")
        with pytest.raises(EmptyKeyError):
            t.delete(bad)
        with pytest.raises(EmptyKeyError):
            t.get(bad)
        with pytest.raises(EmptyValueError):
            t.write(b"k", bad)
    with pytest.raises(KeyTooLargeError):
        t.write(b"k" * 17, b"v")
    with pytest.raises(KeyTooLargeError):
        t.delete(b"k" * 17)
    with pytest.raises(ValueTooLargeError):
        t.write(b"k", b"v" * 17)
    for a, b in ((b"b", b"a"), (b"a", b"a")):
        with pytest.raises(BadRangeError):
            t.iterator(a, b)
    with pytest.raises(EmptyKeyError):
        t.iterator(b"", b"a")


def test_close_reopen_and_old_versions(spark, tmp_path):
    t = Table(spark, options(tmp_path))
    t.write(b"a", b"1")
    t.write(b"b", b"2")
    t.close()
    t.close()  # closing again publishes nothing
    assert t.versions() == [1]
    with pytest.raises(ClosedError):
        t.write(b"a", b"1")
    with pytest.raises(ClosedError):
        t.delete(b"a")
    assert t.get(b"a") == b"1"  # reads go on
    u = Table(spark, options(tmp_path))
    assert (u.get(b"a"), u.get(b"b"), u.get(b"c")) == (b"1", b"2", None)
    u.delete(b"a")
    u.write(b"c", b"3")
    u.commit()
    assert rows(u) == [(b"b", b"2"), (b"c", b"3")]
    old = Table(spark, options(tmp_path), version=1)
    assert rows(old) == [(b"a", b"1"), (b"b", b"2")]
    with pytest.raises(ClosedError):
        old.write(b"x", b"y")
    with pytest.raises(SnapshotError):
        Table(spark, options(tmp_path), version=9)


def test_overwrites_leave_other_keys_alone(spark, tmp_path):
    t = Table(spark, options(tmp_path))
    for i in range(7):
        t.write(b"%d" % i, b"x")
    t.write(b"5", b"y")
    t.write(b"5", b"y")  # the same again changes nothing
    size = t.staged_bytes
    assert size == 14
    assert rows(t) == [(b"%d" % i, b"y" if i == 5 else b"x") for i in range(7)]
    # a range that begins beyond, between and after the keys
    assert [k for k, _ in rows(t, b"4", b"9")] == [b"4", b"5", b"6"]
    assert [k for k, _ in rows(t, b"33", b"45")] == [b"4"]
    assert rows(t, b"7", b"9") == [] and rows(t, b"0", b"00")[0][0] == b"0"


def test_deletes_hide_older_layers(spark, tmp_path):
    t = Table(spark, options(tmp_path, levels=()))
    t.write(b"a", b"1")
    t.write(b"b", b"1")
    t.commit()
    t.delete(b"a")
    assert rows(t) == [(b"b", b"1")] and t.get(b"a") is None  # staged delete over a run
    t.commit()
    assert rows(t) == [(b"b", b"1")]
    assert t.view(keep_tombstones=True).count() == 1  # the sink holds no tombstone
    t.delete(b"b")
    t.commit()  # the sink is empty now and can be flushed into again
    assert rows(t) == []
    t.write(b"c", b"1")
    t.commit()
    assert rows(t) == [(b"c", b"1")]


def test_overflow_moves_down_and_deeper_levels_stay(spark, tmp_path):
    levels = tuple(Level(block_size=64, run_size=60, cache_size=256, bloom_bits=64, max_runs=1) for _ in range(2))
    t = Table(spark, options(tmp_path, levels=levels))
    want = {}
    for batch in range(4):
        for i in range(12):
            k, v = b"k%02d" % ((i * 5 + batch * 7) % 40), b"%d" % batch
            t.write(k, v)
            want[k] = v
        t.commit()
        assert rows(t) == sorted(want.items())
    assert all(t.snapshot.levels) and len(t.snapshot.levels) == 3
    before = t.snapshot.levels[2]
    t.delete(b"k00")
    want.pop(b"k00", None)
    t.commit()
    assert rows(t) == sorted(want.items()) and t.snapshot.levels[2] is not None and before
    assert rows(Table(spark, t.options)) == sorted(want.items())


def test_batches(spark, tmp_path):
    t = Table(spark, options(tmp_path))
    schema = "key binary, value binary, seq long"
    t.apply(spark.createDataFrame([(b"a", b"1", 5), (b"a", b"2", 9), (b"b", b"1", 6)], schema))
    t.apply(spark.createDataFrame([(b"b", None, 0), (b"c", b"3", 0)], schema))
    assert rows(t) == [(b"a", b"2"), (b"c", b"3")]
    version = t.snapshot.version
    for bad, error in (((b"", b"1", 0), EmptyKeyError), ((None, b"1", 0), EmptyKeyError), ((b"k" * 17, b"1", 0), KeyTooLargeError), ((b"k", b"", 0), EmptyValueError), ((b"k", b"v" * 17, 0), ValueTooLargeError)):
        with pytest.raises(error):
            t.apply(spark.createDataFrame([(b"ok", b"1", 1), bad], schema))
    t.apply(spark.createDataFrame([], schema))
    assert t.snapshot.version == version and t.get(b"ok") is None
    got = t.multi_get(spark.createDataFrame([(b"a",), (b"a",), (b"x",)], "key binary")).collect()
    assert [bytes(r.key) for r in got] == [b"a"]


def test_size_triggers_a_commit_and_writers_conflict(spark, tmp_path):
    t = Table(spark, options(tmp_path, memtable_size=6))
    t.write(b"a", b"12")
    t.write(b"b", b"12")
    assert t.snapshot.version == 0  # exactly at the limit
    t.write(b"c", b"12")
    t.commit()  # waits for the flush
    assert t.snapshot.version == 1 and t.staged_bytes == 0
    u = Table(spark, options(tmp_path))
    t.write(b"d", b"1")
    t.commit()
    u.write(b"e", b"1")
    with pytest.raises(ConflictError):
        u.commit()
    assert u.get(b"e") == b"1"  # still staged


def test_random_against_a_dict(spark, tmp_path):
    rng = random.Random(11)
    levels = (Level(block_size=64, run_size=150, cache_size=256, bloom_bits=64, max_runs=1),)
    t, want = Table(spark, options(tmp_path, levels=levels)), {}
    for step in range(120):
        k = b"%x" % rng.randrange(40)
        if rng.random() < 0.3:
            t.delete(k)
            want.pop(k, None)
        else:
            v = b"%d" % rng.randrange(1000)
            t.write(k, v)
            want[k] = v
        if step % 40 == 17:
            t.commit()
        if step % 40 == 39:
            t.close()
            t = Table(spark, t.options)
        if step % 30 == 29:
            assert rows(t) == sorted(want.items())
            a, b = sorted([b"%x" % rng.randrange(40), b"%x" % rng.randrange(40)])
            assert rows(t, a, b) == [x for x in sorted(want.items()) if a <= x[0] <= b]
            assert t.get(k) == want.get(k)


def test_cursor(spark, tmp_path):
    t = Table(spark, options(tmp_path))
    for i in range(3):
        t.write(b"%d" % i, b"v")
    c = t.iterator(b"0", b"2")
    with pytest.raises(NotPositionedError):
        c.get()
    t.write(b"1", b"later")  # the cursor reads what was there when it was made
    assert [(bytes(r.key), bytes(r.value)) for r in c] == [(b"%d" % i, b"v") for i in range(3)]
    assert not c.next()
    with pytest.raises(ExhaustedError):
        c.get()
    c.close()
    with pytest.raises(ExhaustedError):
        c.next()
    assert not Cursor(None).next()


def test_options():
    good = Options("/x", (Level(),), Sink())
    assert good.validate() == [] and good.level(0) is good.levels[0] and good.level(1) is good.sink
    for i in (-1, 2):
        with pytest.raises(NoSuchLevelError):
            good.level(i)
    bad = Options("", (Level(block_size=1, cache_size=0, cache_shards=0, run_size=0, bloom_bits=0, max_runs=0),), None, 0, 2, 2)
    found = "; ".join(bad.validate())
    for word in ("path", "memtable_size", "largest key", "largest value", "cache_size", "cache_shards", "run_size", "bloom_bits", "max_runs", "sink must"):
        assert word in found
    with pytest.raises(OptionsError) as e:
        bad.check()
    assert len(e.value.problems) == len(bad.validate())


def test_cache():
    c, loads = ShardedCache(2 * 2 * (ENTRY + 8 + 5), 2), []

    def load(k, size=5):
        return c.get(k, lambda: loads.append(k) or b"x" * size)

    for k in (0, 2, 0, 4, 0, 2):  # one shard of two entries: 2 goes when 4 comes
        load(k)
    assert loads == [0, 2, 4, 2]
    load(1)
    c.evict(1)
    c.evict(99)
    load(1)
    assert loads[-2:] == [1, 1]
    load(3, 999)  # larger than a shard: returned, not kept
    load(3, 999)
    assert loads[-2:] == [3, 3]
    for args in ((10, 0), (0, 1)):
        with pytest.raises(ValueError):
            ShardedCache(*args)
    # misses weigh something too
    small = ShardedCache(1000)
    for i in range(5000):
        assert small.get(("file", b"%d" % i), lambda: None) is None
    assert len(small) < 15


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert snapshots.versions(spark, folder) == [] and snapshots.read(spark, folder).version == 0
    one = snapshots.Snapshot(1, 7, ((snapshots.File("a", b"k", b"z", 9, 2),), (snapshots.File("b", b"", b"a", 1, 1), snapshots.File("c", b"b", b"c\xff", 2, 1))))
    assert one.paths(1, b"ab") == ["c"] and one.paths(1, None, b"a") == ["b"] and one.paths(1, b"ab", b"ac") == [] and one.paths(0) == ["a"]
    snapshots.publish(spark, folder, one)
    snapshots.publish(spark, folder, snapshots.Snapshot(10, 8, ()))
    assert snapshots.versions(spark, folder) == [1, 10] and snapshots.read(spark, folder).next_seq == 8
    assert snapshots.read(spark, folder, 1) == one
    with pytest.raises(ConflictError):
        snapshots.publish(spark, folder, one)
    with pytest.raises(SnapshotError):
        snapshots.Snapshot.loads("{")


def test_untouched_sink_files_keep_their_names(spark, tmp_path):
    t = Table(spark, options(tmp_path, levels=()))
    schema = "key binary, value binary, seq long"
    want = {b"%03d" % i: b"v" * 10 for i in range(150)}
    t.apply(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(want.items())], schema))
    first = t.snapshot.levels[-1]
    assert len(first) > 5 and all(a.hi < b.lo for a, b in zip(first, first[1:])) and sum(f.records for f in first) == 150
    # two places that lie apart, a new key before all, one behind all and one in a gap
    changes = [(b"0", b"new"), (b"010", None), (b"0105", b"gap"), (b"100", b"w"), (b"9", b"end")]
    t.apply(spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(changes)], schema))
    for k, v in changes:
        want.pop(k, None)
        if v is not None:
            want[k] = v
    second = t.snapshot.levels[-1]
    assert len(set(first) & set(second)) >= len(first) - 4 and all(a.hi < b.lo for a, b in zip(second, second[1:]))
    assert rows(t) == sorted(want.items()) and rows(t, b"0104", b"012") == [x for x in sorted(want.items()) if b"0104" <= x[0] <= b"012"]
    # a lookup opens one file at most, and none where no range has the key
    assert t.get(b"0105") == b"gap" and t.get(b"010") is None and t.get(b"zzz") is None
    assert sum(c.misses for c in t.caches) <= 2


def test_writers_beside_commits_lose_nothing(spark, tmp_path):
    import threading
    import time

    t = Table(spark, options(tmp_path, memtable_size=200))
    want = {}

    def write(name):
        for i in range(60):
            k, v = b"%s%d" % (name, i % 20), b"%d" % i
            t.write(k, v)
            want[k] = v
            time.sleep(0.03)  # so that several commits fall between the writes

    threads = [threading.Thread(target=write, args=(name,)) for name in (b"a", b"b", b"c")]
    for x in threads:
        x.start()
    seen = []
    while any(x.is_alive() for x in threads):
        t.commit()
        seen.append(len(rows(t)))
    for x in threads:
        x.join()
    assert seen == sorted(seen)  # no key that was written is missing later
    assert rows(t) == sorted(want.items())
    t.close()
    assert rows(Table(spark, t.options)) == sorted(want.items()) and t.snapshot.version >= 2


def test_a_failed_flush_keeps_what_it_held(spark, tmp_path, monkeypatch):
    import sedimenta.store as store

    t = Table(spark, options(tmp_path))
    t.write(b"a", b"1")
    real = store.flush

    def fail(*args):
        t.write(b"a", b"2")  # written while the flush runs
        t.write(b"b", b"3")
        raise OSError("no space")

    monkeypatch.setattr(store, "flush", fail)
    with pytest.raises(OSError):
        t.commit()
    assert t.get(b"a") == b"2" and t.staged_bytes == 4
    monkeypatch.setattr(store, "flush", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(OSError):
        t.close()
    monkeypatch.setattr(store, "flush", real)
    t.close()  # it isn't closed before all is stored
    assert rows(Table(spark, t.options)) == [(b"a", b"2"), (b"b", b"3")]
    # a flush in the background fails: the next commit says so, and the one after it stores
    u = Table(spark, options(tmp_path / "u", memtable_size=1))
    monkeypatch.setattr(store, "flush", lambda *a: (_ for _ in ()).throw(OSError("no space")))
    u.write(b"k", b"1")
    with pytest.raises(OSError):
        u.commit()
    monkeypatch.setattr(store, "flush", real)
    assert u.get(b"k") == b"1" and u.commit() and rows(u) == [(b"k", b"1")]
