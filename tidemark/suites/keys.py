"""Keying, cleaning, censoring and split queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import keys, temporal
from tidemark.operators.labels import make_labels
from tidemark.sources.schema import RelDatabase, RelTable, TaskSpec, derived_time
from tidemark.suites.common import star
from tidemark.suites.labels import LABELS, QUARTER, anchors_cte

VAL, TEST = datetime(2000, 10, 1), datetime(2001, 1, 1)
EARLIEST = datetime(1995, 1, 1)
CHURN = TaskSpec("churn", "binary_classification", "customer", "c_custkey", "timestamp", "churn", QUARTER, LABELS["label_customer_decline"][3])


def rekey_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.dense_ids(star(spark, sf_dir, "orders")["orders"])


def rekey_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The re-keyed line items: references are dense ids, misses null."""
    db, _ = keys.rekey(star(spark, sf_dir, "customer", "orders", "lineitem"))
    return db["lineitem"].df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))


def fk_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' customers through a map that only has customers in credit."""
    db = star(spark, sf_dir, "customer", "orders")
    good = RelTable(db["customer"].df.where("c_acctbal > 0"), "c_custkey")
    return keys.remap(db["orders"].df.select("o_orderkey", "o_custkey"), "o_custkey", keys.dense_ids(good))


def id_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer")
    ids = keys.dense_ids(db["customer"])
    asked = db["customer"].df.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("old"))
    inside = keys.to_internal(asked, ids)
    return keys.to_external(inside.withColumnRenamed("new", "c_custkey"), "c_custkey", ids)


def dup_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = star(spark, sf_dir, "lineitem", columns={"lineitem": ("l_orderkey", "l_linenumber", "l_shipdate")})["lineitem"].df
    return keys.duplicate_keys(items, ["l_orderkey", "l_linenumber"])


def null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late lines as a left join leaves them."""
    db = star(spark, sf_dir, "orders", "lineitem")
    late = db["lineitem"].df.where("l_quantity > 45").select("l_orderkey", "l_quantity", "l_shipdate")
    return keys.null_census(db["orders"].df.select("o_orderkey", "o_orderdate").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left"))


def clean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = star(spark, sf_dir, "orders")["orders"]
    dirty = orders.df.withColumn("Unnamed: 0", F.lit(1)).withColumn("empty", F.lit(None).cast("double"))
    return keys.clean_columns(RelDatabase({"orders": orders.with_df(dirty)}))["orders"].df


def censor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = star(spark, sf_dir, "customer", "orders", "lineitem").upto(VAL)
    parts = [t.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in frozen.tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fk_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped before the cutoff whose order is placed after it lose the reference."""
    frozen = temporal.freeze(star(spark, sf_dir, "orders", "lineitem"), VAL)
    return frozen["lineitem"].df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))


def anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = star(spark, sf_dir, "orders").time_bounds()
    grid = [("train", a) for a in temporal.train_anchors(VAL, QUARTER, bounds[0])]
    grid += [("val", a) for a in temporal.eval_anchors(VAL, QUARTER, 2, TEST)] + [("test", a) for a in temporal.eval_anchors(TEST, QUARTER, 1)]
    return spark.createDataFrame(grid, "split string, timestamp timestamp_ntz")


def _labels(spark: SparkSession, db: RelDatabase) -> tuple[DataFrame, DataFrame, DataFrame]:
    censored = db.upto(TEST)
    train = make_labels(spark, censored, CHURN, temporal.train_anchors(VAL, QUARTER, EARLIEST), check=False)
    val = make_labels(spark, censored, CHURN, [VAL], check=False)
    return train, val, make_labels(spark, db, CHURN, [TEST], check=False)


def split_train_val_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "orders")
    train, val, test = _labels(spark, db)
    inner = temporal.inner_split(db, "customer", "c_custkey", train, val, VAL, "churn")
    outer = temporal.outer_split(db, "customer", "c_custkey", train, val, test, TEST, "churn")
    rows = [("inner_train", inner.train), ("inner_val", inner.target), ("outer_test", outer.eval)]
    parts = [d.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("split"), "timestamp", "n") for n, d in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def masked_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "orders")
    train, val, test = _labels(spark, db)
    return temporal.outer_split(db, "customer", "c_custkey", train, val, test, TEST, "churn").eval


def concat_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val, _ = _labels(spark, star(spark, sf_dir, "customer", "orders"))
    return temporal.concat_labels(train, val)


def dangling_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order seeds at the cutoff, orders of later days left out."""
    db = star(spark, sf_dir, "orders", "lineitem")
    seeds = db["lineitem"].df.select("l_orderkey", F.col("l_shipdate").alias("timestamp")).distinct()
    frozen = db.upto(VAL)["orders"]
    return temporal.drop_dangling(seeds, "l_orderkey", frozen.df, frozen.pkey)


def prediction_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.prediction_seeds(star(spark, sf_dir, "orders"), "orders", "o_orderkey", "timestamp", VAL)


def prediction_seed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer")
    ids = db["customer"].df.where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return temporal.prediction_seeds(db, "customer", "c_custkey", "timestamp", VAL, ids)


def test_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "orders")
    temporal.check_coverage(db, TEST, QUARTER, 1)
    return make_labels(spark, db, CHURN, temporal.eval_anchors(TEST, QUARTER, 1))


def max_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = star(spark, sf_dir, "orders", "lineitem").time_bounds()[1]
    return spark.createDataFrame([(high,)], "latest timestamp_ntz")


def derived_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items take the time of their order."""
    db = star(spark, sf_dir, "orders", "lineitem")
    items = RelTable(db["lineitem"].df.select("l_orderkey", "l_linenumber", "l_quantity"), fkeys={"l_orderkey": "orders"})
    timed = derived_time(items, db["orders"], "l_orderkey", "purchased")
    return timed.df.groupBy("purchased").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


QUERIES = {
    f.__name__: f
    for f in (
        rekey_orders, rekey_database, fk_remap, id_translation, dup_key_check, null_census, clean_columns, censor_counts, fk_scrub,
        anchor_grid, split_train_val_test, masked_test, concat_train_val, dangling_seeds, prediction_seed, prediction_seed_ids,
        test_label_coverage, max_timestamp, derived_event_time,
    )
}

_TRAIN = temporal.train_anchors(VAL, QUARTER, EARLIEST)


def _churn(anchors: list[datetime], source: str = "orders") -> str:
    spent = "sum(o_totalprice) FILTER (o_orderdate {} timestamp)"
    return f"""WITH {anchors_cte(anchors)}
      SELECT timestamp, c_custkey, CAST(coalesce({spent.format(">")}, 0) < 0.5 * {spent.format("<=")} AS INTEGER) AS churn
      FROM timestamp_df, customer, {source}
      WHERE c_custkey = o_custkey AND o_orderdate > timestamp - INTERVAL '91 days' AND o_orderdate <= timestamp + INTERVAL '91 days'
      GROUP BY timestamp, c_custkey HAVING min(o_orderdate) <= timestamp"""


_CENSORED = f"(SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '{TEST}') oo"
_RANKED_ORDERS = "SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS new FROM orders"
_grid = lambda split, anchors: " UNION ALL ".join(f"SELECT '{split}' AS split, TIMESTAMP '{a}' AS timestamp" for a in anchors)

ORACLES = {
    "rekey_orders": _RANKED_ORDERS,
    "rekey_database": f"""WITH m AS ({_RANKED_ORDERS})
        SELECT m.new AS l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity
        FROM lineitem LEFT JOIN m ON m.old = l_orderkey GROUP BY m.new""",
    "fk_remap": """WITH m AS (SELECT c_custkey AS old, row_number() OVER (ORDER BY c_custkey) - 1 AS new FROM customer WHERE c_acctbal > 0)
        SELECT o_orderkey, m.new AS o_custkey FROM orders LEFT JOIN m ON m.old = o_custkey""",
    "id_translation": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "dup_key_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "null_census": """SELECT count(*) AS n_rows, count(o_orderkey) AS nn_o_orderkey, count(o_orderdate) AS nn_o_orderdate,
          count(l_orderkey) AS nn_l_orderkey, count(l_quantity) AS nn_l_quantity, count(l_shipdate) AS nn_l_shipdate
        FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey""",
    "clean_columns": "SELECT * FROM orders",
    "censor_counts": f"""SELECT 'customer' AS name, count(*) AS n FROM customer
        UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate <= TIMESTAMP '{VAL}'
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate <= TIMESTAMP '{VAL}'""",
    "fk_scrub": f"""SELECT CASE WHEN o_orderdate <= TIMESTAMP '{VAL}' THEN l_orderkey END AS l_orderkey, count(*) AS n_lines,
          sum(l_quantity) AS quantity
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= TIMESTAMP '{VAL}' GROUP BY 1""",
    "anchor_grid": " UNION ALL ".join([_grid("train", _TRAIN), _grid("val", [a for a in (VAL, VAL + QUARTER) if a < TEST]), _grid("test", [TEST])]),
    "split_train_val_test": f"""SELECT 'inner_train' AS split, timestamp, count(*) AS n FROM ({_churn(_TRAIN, _CENSORED)}) GROUP BY timestamp
        UNION ALL SELECT 'inner_val', timestamp, count(*) FROM ({_churn([VAL], _CENSORED)}) GROUP BY timestamp
        UNION ALL SELECT 'outer_test', timestamp, count(*) FROM ({_churn([TEST])}) GROUP BY timestamp""",
    "masked_test": f"SELECT timestamp, c_custkey FROM ({_churn([TEST])})",
    "concat_train_val": f"SELECT * FROM ({_churn([*_TRAIN, VAL], _CENSORED)})",
    "dangling_seeds": f"""SELECT DISTINCT l_orderkey, l_shipdate AS timestamp FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '{VAL}')""",
    "prediction_seed": f"SELECT o_orderkey, TIMESTAMP '{VAL}' AS timestamp FROM orders WHERE o_orderdate <= TIMESTAMP '{VAL}'",
    "prediction_seed_ids": f"SELECT c_custkey, TIMESTAMP '{VAL}' AS timestamp FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "test_label_coverage": _churn([TEST]),
    "max_timestamp": "SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS latest",
    "derived_event_time": """SELECT o_orderdate AS purchased, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
}
