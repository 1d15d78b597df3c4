import random
import struct

import pytest
from pyspark.sql import functions as F

from sedimenta import queries
from sedimenta.errors import SnapshotError, StoreError
from sedimenta.functions import bytes as fb
from sedimenta.operators import blocks, bloom
from sedimenta.operators import merge as m
from sedimenta.sources import native, runs
from sedimenta.store import Table
from sedimenta.streaming.ingest import ingest

from .test_store import options, rows

LOG = "key binary, value binary, seq long"


def log(spark, data):
    return spark.createDataFrame(data, LOG)


def seen(df):
    return [(bytes(r.key), None if r.value is None else bytes(r.value)) for r in df.orderBy("key").collect()]


def test_merge_takes_the_first_run_then_the_newest(spark):
    new = log(spark, [(b"a", b"1", 1), (b"b", None, 2), (b"d", b"old", 3), (b"d", b"new", 4)])
    old = log(spark, [(b"a", b"9", 99), (b"b", b"9", 98), (b"c", b"9", 97)])
    assert seen(m.merge([new, old])) == [(b"a", b"1"), (b"c", b"9"), (b"d", b"new")]
    assert seen(m.merge([new, old], keep_tombstones=True)) == [(b"a", b"1"), (b"b", None), (b"c", b"9"), (b"d", b"new")]
    assert seen(m.merge([old, new])) == [(b"a", b"9"), (b"b", b"9"), (b"c", b"9"), (b"d", b"new")]
    assert seen(m.merge([m.empty(spark), new])) == [(b"a", b"1"), (b"d", b"new")]
    with pytest.raises(ValueError):
        m.merge([])


def test_merge_against_a_dict(spark):
    rng = random.Random(3)
    layers, want = [], {}
    seq = 0
    for _ in range(4):
        layer = []
        for _ in range(60):
            seq += 1
            k, v = b"%d" % rng.randrange(40), rng.choice([None, b"%d" % seq])
            layer.append((k, v, seq))
            want[k] = v
        layers.insert(0, log(spark, layer))
    assert seen(m.merge(layers)) == sorted((k, v) for k, v in want.items() if v is not None)
    assert seen(m.newest_value(m.layered(layers), ["key"], "value", F.col("seq")).select("key", "value")) == sorted(want.items())


def test_reads_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "r")
    data = [(b"%04d" % i, b"v", i) for i in range(500)]
    runs.write(log(spark, data).repartition(3), path, run_size=2000)
    df = runs.read(spark, [path])
    files = runs.files(df).groupBy("file").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(files) > 1 and sum(f.n for f in files) == 500
    assert all(bytes(x.z) < bytes(y.a) for x, y in zip(files, files[1:]))  # files don't overlap
    v = m.merge([df])
    assert [bytes(r.key) for r in m.range_scan(v, b"0010", b"0012").collect()] == [b"0010", b"0011", b"0012"]
    assert m.range_scan(v, b"9", b"99").count() == 0 and m.get(v, b"0123").count() == 1
    plan = m.get(v, b"0123")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan.split("PushedFilters")[1] and "WindowGroupLimit" in plan
    assert runs.read(spark, []).count() == 0


def test_lookups_filter_before_they_compare(spark):
    old = log(spark, [(b"a", b"1", 1), (b"b", b"1", 2), (b"c", b"1", 3)])
    new = log(spark, [(b"a", b"2", 9), (b"b", None, 8)])
    wanted = spark.createDataFrame([(b"a",), (b"a",), (b"b",), (b"x",), (None,)], "key binary")
    got = m.multi_get([new, old], wanted)
    assert seen(got) == [(b"a", b"2")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")  # the join lies below


def test_levels_and_blocks(spark):
    data = [(i, "x" * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(data, "k int, v string").withColumn("n", F.length("v"))
    got = {r.k: r.upto for r in blocks.running_bytes(df, "k", F.col("n")).collect()}
    total, want = 0, {}
    for k, v in data:
        total += len(v)
        want[k] = total
    assert got == want
    recs = log(spark, [(b"%03d" % i, b"y" * (i % 5 + 1), i) for i in range(200)]).repartitionByRange(4, "key").persist()
    for budget in (0, 6, 100, 700, 10**6):
        used, edge = 0, None
        for i in range(200):
            used += 3 + i % 5 + 1 + 2
            if used > budget:
                break
            edge = b"%03d" % i
            bytes_, count = used, i + 1
        found, size, n = blocks.split_key(recs, budget)
        assert (None if found is None else bytes(found)) == edge and (edge is None or (size, n) == (bytes_, count))
    recs.unpersist()


def test_byte_functions(spark):
    pairs = [(b"", b"a"), (b"a", b"a"), (b"a", b"ab"), (b"\x80", b"\x7f"), (None, b"a")]
    df = spark.createDataFrame(pairs, "a binary, b binary")
    got = [r[0] for r in df.select(fb.compare(F.col("a"), F.col("b"))).collect()]
    assert got == [-1, 0, -1, 1, None]
    got = df.select(fb.record_length(F.col("b"), F.col("a")), fb.ordered_text(F.col("b")), fb.fnv1("a"), fb.fnv1a("a")).collect()
    assert [r[0] for r in got] == [3, 4, 5, 4, 3] and got[3][1] == "7F" and got[4][2] is None
    for i in (0, 1, 2, 3):
        assert got[i][2] == fb.fnv32(pairs[i][0], False) and got[i][3] == fb.fnv32(pairs[i][0], True)
    assert fb.fnv32(b"a", False) == 0x050C5D7E and fb.fnv32(b"a", True) == 0xE40C292C


def test_bloom_denies_nothing_that_is_there(spark):
    data = [(i % 3, b"k%d" % i) for i in range(120)]
    f = bloom.build(spark.createDataFrame(data, "run int, key binary"), bits=512).persist()
    for run, key in data[::17]:
        assert run in {r.run for r in bloom.may_hold(f, key, bits=512).collect()}
    wrong = sum(bloom.may_hold(f, b"none%d" % i, bits=512).count() for i in range(6))
    assert wrong < 12
    f.unpersist()


def _file(path, blocks_of):
    data, index = b"", []
    for recs in blocks_of:
        raw = b"".join(bytes([len(k)]) + k + bytes([len(v)]) + v for k, v in recs)
        index.append((recs[0][0], recs[-1][0], len(raw), len(data)))
        data += raw + b"\0" * 5
    at = len(data)
    data += struct.pack(">q", len(index))
    for a, z, used, off in index:
        data += bytes([len(a)]) + a + bytes([len(z)]) + z + struct.pack(">qq", used, off)
    path.write_bytes(data + struct.pack(">q", at))


def test_native_files(spark, tmp_path, monkeypatch):
    recs = [[(b"a", b"1"), (b"c", b"")], [(b"e", b"2"), (b"g", b"3")], [(b"i", b"4")]]
    _file(tmp_path / "f", recs)
    spark.dataSource.register(native.NativeRuns)
    read = spark.read.format("sorted_runs").option("path", str(tmp_path / "f"))
    assert seen(read.load()) == [(b"a", b"1"), (b"c", None), (b"e", b"2"), (b"g", b"3"), (b"i", b"4")]
    part = read.option("start", b"c".hex()).option("end", b"f".hex()).load()
    assert seen(part) == [(b"c", None), (b"e", b"2")]  # a range that ends in a gap
    assert {r.block for r in part.collect()} == {0, 1}
    assert len(native._Reader({"path": str(tmp_path / "f"), "start": b"h".hex()}).partitions()) == 1
    # written and read again, in parts
    monkeypatch.setattr(native, "SPLIT", 64)
    records = [(b"%03d" % i, b"v" * (i % 30) or None) for i in range(100)]
    blocks_ = native.write_file(str(tmp_path / "g"), records, 64)
    assert native.block_index(str(tmp_path / "g")) == blocks_ and len(blocks_) > 10
    reader = native._Reader({"path": f"{tmp_path}/g,{tmp_path}/f"})
    parts = reader.partitions()
    got = [x for p in parts for b in reader.read(p) for x in zip(b["key"].to_pylist(), b["value"].to_pylist())]
    assert len(parts) > 10 and sorted(got, key=repr) == sorted(records + [(b"a", b"1"), (b"c", None), (b"e", b"2"), (b"g", b"3"), (b"i", b"4")], key=repr)
    for bad in ([(b"b", b"1"), (b"a", b"1")], [(b"a", b"1"), (b"a", b"2")], [(b"", b"1")], [(b"k" * 256, b"1")]):
        with pytest.raises(StoreError):
            native.write_file(str(tmp_path / "h"), bad)
    native.write_manifest(str(tmp_path / "n"), [["/a", "/b"], [], ["/c"]])
    assert native.read_manifest(str(tmp_path / "n")) == [["/a", "/b"], [], ["/c"]]
    (tmp_path / "short").write_bytes(b"123")
    (tmp_path / "wrong").write_bytes(b"\0" * 16 + struct.pack(">q", 999))
    for name in ("short", "wrong"):
        with pytest.raises(StoreError):
            native.block_index(str(tmp_path / name))
    name = b"/some/file"
    (tmp_path / "m").write_bytes(struct.pack(">II", 2, 1) + bytes([len(name)]) + name + struct.pack(">I", 0))
    assert native.read_manifest(str(tmp_path / "m")) == [["/some/file"], []]
    (tmp_path / "m").write_bytes(struct.pack(">II", 2, 1))
    with pytest.raises(SnapshotError):
        native.read_manifest(str(tmp_path / "m"))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    t = Table(spark, options(tmp_path / "t"))
    for data in ([(b"a", b"1", 1), (b"b", b"1", 2)], [(b"a", None, 1), (b"c", b"2", 0)]):
        log(spark, data).coalesce(1).write.mode("append").parquet(str(src))
        q = ingest(spark.readStream.schema(LOG).parquet(str(src)), t, str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    assert rows(t) == [(b"b", b"1"), (b"c", b"2")] and t.versions() == [1, 2]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    got = queries.QUERIES[name](spark, sf)
    rows_ = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    if name not in queries.ORACLE_SQL:
        assert rows_
        return
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    want = [tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in res.fetchall()]
    assert sorted(got.columns) == sorted(cols) and sorted(map(repr, rows_)) == sorted(map(repr, want))


def test_entry(spark, sf):
    assert queries.entry(spark, sf).count() > 0
