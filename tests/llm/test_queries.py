"""The registered queries and the pipeline on the smallest tables."""

import importlib

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import pfair_mixing, queries, stages


def test__registry__one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test__query__equals_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test__pipeline__stages__keep_columns_and_take_effect(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] == sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == sizes[4]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mixing", "best_fit_packing"]


def test__stages__odd_rows_and_no_rows__columns_kept(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _tm_at string, index long"
    text = "a stone by the river and a light in the garden of the house at night " * 2
    rows = [(i, f"{text} number{i} of many words that differ {i * 7}", "en", "s", 5, None, 1) for i in range(30)]
    rows += [(40, None, None, None, None, None, None), (41, "", "en", None, 0, "x", 1), (None, text + " null id", None, "s", 1, None, 2), (3, rows[3][1], "en", "s", 5, None, 1)]
    docs = spark.createDataFrame(rows, schema)
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").cache()
        sizes[name] = out.count()
        assert stage(spark, docs.limit(0), "").count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "source_mixing":
            assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
        if name == "quality_rules":
            assert {40, 41}.isdisjoint({r.doc_id for r in out.collect()})
    assert sizes["line_dedup"] == sizes["source_mixing"] == len(rows) and sizes["best_fit_packing"] == len(rows)


def test__pipeline__other_weights__other_sequences(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "of some words that are many " * 40, "a" if i < 200 else "b") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    shares, packed = [], []
    for part in (0.9, 0.1):
        given = {"a": part, "b": 1 - part}
        monkeypatch.setattr(stages, "mix_sources", lambda docs, given=given: pfair_mixing.mix_sources(docs, given, block_bytes=5000))
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("source_mixing", stages.mixing_stage), ("best_fit_packing", stages.packing_stage)])
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        packed.append(sorted(map(tuple, got)))
        first = sorted({r.sequence_id for r in got})[:20]
        early = [r.doc_id for r in got if r.sequence_id in first]
        shares.append(sum(i < 200 for i in early) / len(early))
        assert sorted(r.doc_id for r in got) == list(range(400))
    assert packed[0] != packed[1] and shares[0] > 0.8 and shares[1] < 0.2
