import duckdb
import pytest

import corpus_pipeline
from sedimenta.llm import bpe, common, decontam, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    want = [tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in res.fetchall()]
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert sorted(got.columns) == sorted(cols) and sorted(map(repr, rows)) == sorted(map(repr, want)) and rows


def test_stages(spark, sf, tmp_path):
    """Each stage takes away what it should, keeps the columns, and the whole gives tokens of what is left."""
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "tokenize"]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else None
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = before
        if name != "tokenize":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert after.items() <= before.items() and docs.count() == len(after)
        if name == "exact_dedup":
            assert sorted(after) == sorted({t: i for i, t in sorted(before.items(), reverse=True)}.values())
        if name == "decontaminate":
            b = decontam.Benchmark([r.item_id for r in common.table(spark, sf, "benchmark").collect()], [r.text for r in common.table(spark, sf, "benchmark").collect()])
            assert not [i for i, t in after.items() if any(" ".join(x.split()) in " ".join(t.split()) for x in [r.text for r in common.table(spark, sf, "benchmark").collect()])] and len(b.ids)
    c = bpe.codec(bpe.VOCABULARY)
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(after) and all(r.decoded_ok for r in rows)
    for r in rows[::25]:
        assert r.tokens == c.encode_plain(after[r.doc_id])
    labels = {r.doc_id: r for r in common.table(spark, sf, "labels").collect()}
    kept = left["exact_dedup"]  # what the classifier kept
    clean = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
    bad = [i for i, x in labels.items() if x.quality == 0 or x.toxic == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and sum(i in kept for i in bad) <= 0.4 * len(bad)


def rows_of(df):
    return sorted(map(repr, (tuple(map(repr, r)) for r in df.collect())))


def test_run_equals_the_stages(spark, sf, tmp_path):
    """Every row of ``run`` is what the stages give one by one, and only the last stage's folder stays."""
    docs = common.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "tokens", "decoded_ok"] and rows_of(out) == rows_of(docs) and out.count() > 50
    from pathlib import Path

    folder = Path(out.inputFiles()[0].removeprefix("file:").removeprefix("//")).parent.parent
    assert [p.name for p in folder.iterdir()] == ["tokenize"]


def test_odd_rows_pass_all_stages(spark, sf, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, bytes that aren't UTF-8, clashing columns; then no rows at all."""
    import shutil

    words = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    plain = "it was said that this is a text of its own and nothing more"
    item = common.table(spark, sf, "benchmark").first().text
    rows = [(1, plain), (2, plain), (3, plain.upper() + "!"), (4, None), (None, plain), (None, None), (5, ""), (6, ""), (7, " \n"), (8, words), (9, words), (9, words), (10, f"so: {item} and on"), (11, "one")]
    spark.createDataFrame([(i, t, None if i == 11 else "en", None, i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").createOrReplaceTempView("odd")
    odd = spark.sql("select *, 1 as digest, 2 as keep_id, 3 as `__digest`, 4 as sig, 5 as `__drop` from odd union all select 12, cast(X'616220FF63' as string), 'en', null, 5, 1, 2, 3, 4, 5")
    for table in ("odd", "none"):
        folder = tmp_path / table
        folder.mkdir()
        (odd if table == "odd" else odd.limit(0)).write.parquet(str(folder / "documents.parquet"))
        shutil.copy(f"{sf}/benchmark.parquet", folder)
        common.table(spark, sf, "labels").limit(0).write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(folder))
            assert out.columns == docs.columns and (table == "odd" or out.count() == 0), name
        got = corpus_pipeline.run(spark, str(folder)).collect()
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
        # one of the equal texts, also in other case; one without words; rows without id or text
        assert ids == ([(False, i) for i in (1, 4, 5, 8, 11, 12)] + [(True, 0)] * 2 if table == "odd" else [])
        assert all(r.decoded_ok in (True, None) for r in got)


def test_entry_imports_without_these(tmp_path):
    """The entry module stands alone when the optional parts are gone, and only then."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(corpus_pipeline.__file__).parent
    shutil.copytree(repo / "sedimenta", tmp_path / "sedimenta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    names = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert "kv_full_scan" in names and "op1" not in names
    # a fault inside them isn't hidden
    (tmp_path / "sedimenta" / "llm").mkdir()
    (tmp_path / "sedimenta" / "llm" / "__init__.py").write_text("")
    (tmp_path / "sedimenta" / "llm" / "queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
