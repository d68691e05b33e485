"""Kept artifacts: what they follow from, who publishes them, and that models read them."""

from dataclasses import replace
from datetime import datetime

import pytest

from tidemark.cli import find_tasks
from tidemark.models import matrices
from tidemark.operators.labels import run_sql
from tidemark.query import PredictiveQuery
from tidemark.sources import cache
from tidemark.sources.schema import QuerySpec
from tidemark.suites import pipelines


def only(frame):
    rows = {r.churn_pred for r in frame.select("churn_pred").distinct().collect()}
    assert len(rows) == 1
    return rows.pop()


def test__labels__other_sql_or_data__other_artifacts(spark, data, tmp_path):
    spec = pipelines._spec(data)
    flipped = replace(spec, task=replace(spec.task, query=spec.task.query.replace("< 0.5 *", ">= 0.5 *")))
    kept = str(tmp_path / "kept")
    first = only(PredictiveQuery(spark, spec).fit("constant-global", cache_dir=kept).predict())
    again = only(PredictiveQuery(spark, spec).fit("constant-global", cache_dir=kept).predict())
    other = only(PredictiveQuery(spark, flipped).fit("constant-global", cache_dir=kept).predict())
    assert first == again == only(PredictiveQuery(spark, spec).fit("constant-global").predict())
    assert other == only(PredictiveQuery(spark, flipped).fit("constant-global").predict()) != first
    q = PredictiveQuery(spark, spec)
    less = PredictiveQuery(spark, spec, db=type(q.db)({**q.db.tables, "orders": q.db["orders"].with_df(q.db["orders"].df.where("o_orderkey % 2 = 0"))}))
    a, b = (x.labels(kept)[0].count() for x in (q, less))
    assert a > b == less.labels()[0].count()


def test__cached_fit__equals_uncached__and_computes_once(spark, data, tmp_path, monkeypatch):
    spec, kept = pipelines._spec(data), str(tmp_path / "kept")
    made = []
    plain = matrices.dfs.features
    monkeypatch.setattr(matrices.dfs, "features", lambda *a, **k: made.append(a[5]) or plain(*a, **k))
    config = dict(model="dfs-gbt", cache_dir=kept)
    first = {r.c_custkey: r.churn_pred for r in PredictiveQuery(spark, spec).fit(**config).predict().collect()}
    n = len(made)
    again = {r.c_custkey: r.churn_pred for r in PredictiveQuery(spark, spec).fit(**config).predict().collect()}
    assert len(made) == n > 0 and first == again


def test__publish__second_filler__keeps_the_first(spark, tmp_path):
    config = cache.CacheConfig(str(tmp_path / "kept"))

    def slow():
        cache.cached_artifact(spark, config, "a/b", lambda: spark.range(3))  # another filler is faster
        return spark.range(5)

    assert cache.cached_artifact(spark, config, "a/b", slow).count() == 3
    source, target = str(tmp_path / "x"), f"{config.root}/a/b"
    spark.range(1).write.parquet(source)
    assert not cache._move(spark, source, target) and spark.read.parquet(target).count() == 3
    assert cache.cached_artifact(spark, config, "a/b", lambda: spark.range(7), validate=lambda df: df.count() == 7).count() == 7
    with pytest.raises(FileNotFoundError):
        cache.cached_artifact(spark, cache.CacheConfig(config.root, "raise"), "a/c", slow)


def test__label_sql__session_views__stay(spark, data):
    spark.range(7).createOrReplaceTempView("orders")
    q = PredictiveQuery(spark, pipelines._spec(data))
    assert q.labels()[0].count() > 7 and spark.table("orders").count() == 7
    spark.catalog.dropTempView("orders")
    got = run_sql(spark, q.db, spark.sql("SELECT TIMESTAMP_NTZ '1997-01-01' AS timestamp"), """
        WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1000)
        SELECT timestamp, n FROM timestamp_df, (SELECT COUNT(*) AS n FROM big WHERE o_orderdate <= timestamp)""", q.spec.task.timedelta)
    assert got.first().n > 0


def test__flat_files__other_names__load(tmp_path):
    folder = tmp_path / "shop"
    folder.mkdir()
    (folder / "db.yaml").write_text("customers: {pkey: id}\nsales:\n  time_col: at\n  fkeys: {customer: customers}\nplain:\n")
    (folder / "again.yaml").write_text("""
database: db.yaml
entity_table: customers
entity_col: id
time_col: at
target_col: bought
task_type: binary_classification
timedelta: 30 days
num_eval_timestamps: 4
val_timestamp: '2005-01-01 00:00:00'
test_timestamp: '2010-01-01 00:00:00'
entities: [3, 4]
query: SELECT 1
""")
    spec = QuerySpec.from_yaml(folder / "again.yaml")
    assert (spec.task.name, spec.task.kind, spec.task.n_eval, spec.entities, spec.at) == ("again", "binary_classification", 4, [3, 4], None)
    assert (spec.database.name, spec.database.val_timestamp, spec.database.test_timestamp) == ("shop", datetime(2005, 1, 1), datetime(2010, 1, 1))
    assert set(spec.database.tables) == {"customers", "sales", "plain"} and spec.database.tables["plain"].path == str(folder / "plain.parquet")
    assert list(find_tasks(tmp_path)) == ["shop/again"]
