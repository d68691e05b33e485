"""End-to-end queries: the facade, experiments, sinks read back, and window labels."""

from __future__ import annotations

import uuid
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cli import find_tasks
from tidemark.models import harness
from tidemark.operators import temporal
from tidemark.models.matrices import cached_features
from tidemark.query import PredictiveQuery
from tidemark.sources.cache import CacheConfig, cache_key, cached_artifact
from tidemark.sources.export import text_store, write_dataset
from tidemark.sources.schema import DatabaseSpec, QuerySpec, TableSpec, TaskSpec, materialize
from tidemark.streaming.windows import window_labels
from tidemark.suites.common import star
from tidemark.suites.features import tidy
from tidemark.suites.keys import CHURN, EARLIEST, TEST, VAL, _churn
from tidemark.suites.labels import QUARTER

SPENDING = TaskSpec("spending", "regression", "customer", "c_custkey", "timestamp", "spent", QUARTER, """
    SELECT timestamp, c_custkey, SUM(o_totalprice) AS spent FROM timestamp_df, customer, orders
    WHERE o_custkey = c_custkey AND o_orderdate > timestamp AND o_orderdate <= timestamp + INTERVAL '{timedelta}'
    GROUP BY timestamp, c_custkey""")


def _spec(sf_dir: str, task: TaskSpec = CHURN) -> QuerySpec:
    tables = {
        "nation": TableSpec(f"{sf_dir}/nation.parquet", "n_nationkey", columns=("n_nationkey", "n_name")),
        "customer": TableSpec(f"{sf_dir}/customer.parquet", "c_custkey", None, {"c_nationkey": "nation"}, ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")),
        "orders": TableSpec(f"{sf_dir}/orders.parquet", "o_orderkey", "o_orderdate", {"o_custkey": "customer"}, ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")),
    }
    return QuerySpec(DatabaseSpec("star", tables, VAL, TEST), task)


def _shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base}/tidemark-{uuid.uuid4().hex}"


def predict_constant_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PredictiveQuery(spark, _spec(sf_dir)).fit("constant-per-entity").predict()


def predict_constant_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through dense keys and back, for the customers asked for."""
    asked = star(spark, sf_dir, "customer")["customer"].df.where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return PredictiveQuery(spark, _spec(sf_dir), rekey=True).fit("constant-per-entity").predict(entities=asked)


def predict_median_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PredictiveQuery(spark, _spec(sf_dir, SPENDING)).fit("constant-per-entity").predict()


def predict_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PredictiveQuery(spark, _spec(sf_dir)).fit("gbt").predict()


def predict_dfs_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PredictiveQuery(spark, _spec(sf_dir)).fit("dfs-gbt").predict()


def experiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both constants tuned, refitted and scored on the test labels."""
    q = PredictiveQuery(spark, _spec(sf_dir))
    train, val = q.labels()
    test = q.compute_test_labels()
    inner = temporal.inner_split(q.db, "customer", "c_custkey", train, val, VAL, "churn")
    outer = temporal.outer_split(q.db, "customer", "c_custkey", train, val, test, TEST, "churn")
    names = ("constant-global", "constant-per-entity")
    done = [harness.run_experiment(m, "star", CHURN, inner, outer, test) for m in names]
    kept = harness.to_frame(spark, done).select("model", "dataset", "task", "metric", "tag", "selected", "val_roc_auc", "val_accuracy", "test_score")
    numbers = ("val_roc_auc", "val_accuracy", "test_score")
    return kept.select(*[c for c in kept.columns if c not in numbers], *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in numbers])


def task_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, kind, entity and step of the task files beside the package; no data is read."""
    specs = [QuerySpec.from_yaml(p) for p in find_tasks(Path(__file__).resolve().parents[2] / "tasks").values()]
    rows = [(x.task.name, x.task.kind, x.task.entity_table, x.task.timedelta.days, len(x.database.tables)) for x in specs]
    return spark.createDataFrame(rows, "name string, kind string, entity string, step_days int, n_tables int")


def cached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed once, read back from the store the second time."""
    config = CacheConfig(_shared(spark))
    key = cache_key(["labels", "star", "churn", "test"])
    build = lambda: PredictiveQuery(spark, _spec(sf_dir)).compute_test_labels()
    cached_artifact(spark, config, key, build)
    return cached_artifact(spark, CacheConfig(config.root, "raise"), key, build)


def warmed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth 2 of a matrix kept at depth 3, read in strict mode after it was filled."""
    q = PredictiveQuery(spark, _spec(sf_dir))
    test = q.compute_test_labels()
    root = _shared(spark)
    for policy in ("fill", "raise"):
        out = cached_features(spark, CacheConfig(root, policy), q.db, CHURN, test, max_depth=3, depth=2)
    return tidy(out.select("c_custkey", "timestamp", "`d2__customer.COUNT(orders)`", "`d2__customer.SUM(orders.o_totalprice)`"))


def export_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported masked test split, read back: the target is a constant 0 of the training type."""
    folder = _shared(spark)
    q = PredictiveQuery(spark, _spec(sf_dir))
    train, val = q.labels()
    test = q.compute_test_labels().drop("churn")
    write_dataset(folder, "star", q.db, CHURN, {"train": train, "val": val, "test": test})
    return spark.read.parquet(f"{folder}/splits/test.parquet")


def materialized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _shared(spark)
    materialize(star(spark, sf_dir, "nation", "customer", columns={"customer": ("c_custkey", "c_nationkey", "c_acctbal")}), folder)
    nations, customers = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("nation", "customer"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_name")


def text_store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part types by content hash that customers' segments do not have."""
    db = star(spark, sf_dir, "part", "customer")
    known = text_store(db["customer"].df, "c_mktsegment")
    return text_store(db["part"].df, "p_type", known)


def stream_window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums per user over three-day windows (t, t + 3 days], as a stream would keep them."""
    out = window_labels(star(spark, sf_dir, "events")["events"].df, "ts", "user_id", timedelta(days=3), value_col="value")
    return out.withColumn("total", F.floor(F.col("total") * 1e4 + 0.5) / 1e4)


QUERIES = {
    f.__name__: f
    for f in (
        predict_constant_entity, predict_constant_rekeyed, predict_median_spending, predict_gbt, predict_dfs_gbt, experiment_results, task_catalogue,
        cached_labels, warmed_matrix, export_splits, materialized_tables, text_store_keys, stream_window_labels,
    )
}

_TRAIN = temporal.train_anchors(VAL, QUARTER, EARLIEST)
_CENSORED = f"(SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '{TEST}') oo"
_BOTH = f"WITH tr AS ({_churn([*_TRAIN, VAL], _CENSORED)}), g AS (SELECT c_custkey, avg(churn) AS m FROM tr GROUP BY 1)"
_PREDICTED = f"""{_BOTH} SELECT c_custkey, TIMESTAMP '{TEST}' AS timestamp, coalesce(m, (SELECT avg(churn) FROM tr)) AS churn_pred
  FROM customer LEFT JOIN g USING (c_custkey)"""
_anchors = ", ".join(f"(TIMESTAMP '{a}')" for a in [*_TRAIN, VAL])

ORACLES = {
    "predict_constant_entity": _PREDICTED,
    "predict_constant_rekeyed": f"{_PREDICTED} WHERE c_mktsegment = 'MACHINERY'",
    "predict_median_spending": f"""WITH t AS (SELECT * FROM (VALUES {_anchors}) v(timestamp)),
        tr AS (SELECT timestamp, o_custkey, sum(o_totalprice) AS spent FROM t, {_CENSORED}
          WHERE o_orderdate > timestamp AND o_orderdate <= timestamp + INTERVAL '91 days' GROUP BY 1, 2),
        g AS (SELECT o_custkey, median(spent) AS m FROM tr GROUP BY 1)
        SELECT c_custkey, TIMESTAMP '{TEST}' AS timestamp, coalesce(m, (SELECT median(spent) FROM tr)) AS spent_pred
        FROM customer LEFT JOIN g ON o_custkey = c_custkey""",
    "task_catalogue": """SELECT * FROM (VALUES ('customer-decline', 'binary_classification', 'customer', 91, 6), ('customer-spending', 'regression', 'customer', 91, 6),
        ('part-discounts', 'regression', 'part', 91, 6), ('part-returned', 'binary_classification', 'part', 91, 6)) v(name, kind, entity, step_days, n_tables)""",
    "cached_labels": _churn([TEST]),
    "warmed_matrix": f"""WITH s AS ({_churn([TEST])}) SELECT timestamp, c_custkey, count(o_orderkey)::DOUBLE AS "d2__customer_COUNT_orders",
          floor(sum(o_totalprice) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS "d2__customer_SUM_orders_o_totalprice"
        FROM s LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < timestamp GROUP BY ALL""",
    "export_splits": f"SELECT timestamp, c_custkey, 0::INTEGER AS churn FROM ({_churn([TEST])})",
    "materialized_tables": "SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "text_store_keys": "SELECT DISTINCT sha256(p_type) AS key, p_type AS text FROM part WHERE p_type NOT IN (SELECT c_mktsegment FROM customer)",
    "stream_window_labels": """SELECT TIMESTAMP '1970-01-01' + INTERVAL (((epoch_us(ts) - 1) // 259200000000) * 3) DAY AS timestamp, user_id, count(*) AS n,
          floor(sum(value) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS total FROM events GROUP BY 1, 2""",
}
