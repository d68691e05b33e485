"""Feature queries: attributes, calendar, as-of lags, texts and multi-hop aggregates."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import calendar, cyclic, epoch_ns, quoted, sigmoid, temporal_diff
from tidemark.operators import dfs, scaling
from tidemark.operators.asof import asof_lags, lookup_text
from tidemark.operators.features import entity_features
from tidemark.operators.labels import make_labels
from tidemark.operators.temporal import anchor_frame
from tidemark.suites.common import star
from tidemark.suites.keys import CHURN, _churn
from tidemark.suites.labels import ORDER_ANCHORS, anchors_cte

FEW = ORDER_ANCHORS[4::5]
COLUMNS = {
    "customer": ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
    "orders": ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"),
    "lineitem": ("l_orderkey", "l_quantity", "l_shipdate"),
}


def _seeds(spark: SparkSession, sf_dir: str, anchors: list[datetime] = FEW) -> DataFrame:
    """Churn labels at a few anchors."""
    return make_labels(spark, star(spark, sf_dir, "customer", "orders"), CHURN, anchors, check=False)


def tidy(df: DataFrame) -> DataFrame:
    """Plain column names, doubles rounded half up to four places by the same arithmetic as in the SQL."""
    out = []
    for name, kind in df.dtypes:
        plain = name.replace("(", "_").replace(")", "").replace(".", "_")
        c = F.col(quoted(name))
        out.append((((F.floor(c * 10000.0 + 0.5)) / 10000.0).cast("double") if kind == "double" and "epochtime" not in name else c).alias(plain))
    return df.select(*out)


def feat_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _seeds(spark, sf_dir)
    out, _ = entity_features(labels, star(spark, sf_dir, "customer", columns=COLUMNS), "customer", "c_custkey", "timestamp", "churn")
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


def feat_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = star(spark, sf_dir, "orders")["orders"].df
    return orders.select("o_orderkey", *calendar(F.col("o_orderdate")))


def feat_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(anchor_frame(spark, ORDER_ANCHORS).select("timestamp", *cyclic(F.col("timestamp"))))


def feat_temporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star(spark, sf_dir, "orders")["orders"].df.groupBy("o_custkey").agg(
        F.max(epoch_ns(F.col("o_orderdate"))).alias("orders.MAX(o_orderdate_epochtime)"),
        F.stddev_samp(epoch_ns(F.col("o_orderdate"))).alias("orders.STD(o_orderdate_epochtime)"),
        F.max("o_totalprice").alias("plain"),
    )
    return temporal_diff(rows.withColumn("timestamp", F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz")), "timestamp")


def feat_lags_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two totals before each order of a customer, at strictly earlier times."""
    orders = star(spark, sf_dir, "orders", columns=COLUMNS)["orders"].df
    pool = orders.groupBy("o_custkey", F.col("o_orderdate").alias("timestamp")).agg(F.max("o_totalprice").alias("label"))
    anchors = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("timestamp"))
    return asof_lags(anchors, pool, "o_custkey", "timestamp", "label", 2, "o_orderkey", "total")


def feat_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "orders")
    return lookup_text(db["orders"].df.select("o_orderkey", "o_custkey"), "o_custkey", db["customer"].df, "c_custkey", ["c_name", "c_mktsegment"])


def _without(df: DataFrame, *parts: str) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if not any(p in c for p in parts)])


def dfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "nation", "orders", columns=COLUMNS)
    out = dfs.features(_seeds(spark, sf_dir), db, "customer", "c_custkey", "timestamp", 2, target_col="churn")
    return tidy(_without(out, "MEAN(orders.o_orderdate"))


def dfs_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sums and counts; inner rows keep the anchor's cutoff."""
    db = star(spark, sf_dir, "customer", "orders", "lineitem", columns=COLUMNS)
    out = dfs.features(_seeds(spark, sf_dir, FEW[:2]), db, "customer", "c_custkey", "timestamp", 3, target_col="churn")
    names = ["c_custkey", "timestamp"] + [
        f"d3__customer.{f}" for f in (
            "MAX(orders.SUM(lineitem.l_quantity))", "SUM(orders.COUNT(lineitem))", "MEAN(orders.MEAN(lineitem.l_quantity))",
            "STD(orders.MIN(lineitem.l_quantity))", "MIN(orders.MAX(lineitem.l_shipdate_epochtime))")
    ]
    return tidy(out.select(*[quoted(n) for n in names]))


def dfs_depth4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From regions: three hops of children below the entity."""
    db = star(spark, sf_dir, "nation", "customer", "orders", "lineitem", columns=COLUMNS)
    seeds = star(spark, sf_dir, "nation", columns=COLUMNS)["nation"].df.select("n_nationkey").crossJoin(
        F.broadcast(anchor_frame(spark, FEW[:2]))
    )
    out = dfs.features(seeds, db, "nation", "n_nationkey", "timestamp", 4)
    names = ["n_nationkey", "timestamp"] + [
        f"d4__nation.{f}" for f in ("MAX(customer.SUM(orders.COUNT(lineitem)))", "SUM(customer.MAX(orders.SUM(lineitem.l_quantity)))")
    ]
    return tidy(out.select(*[quoted(n) for n in names]))


def dfs_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth 2 as a projection of the depth 3 matrix."""
    db = star(spark, sf_dir, "customer", "orders", "lineitem", columns=COLUMNS)
    deep = dfs.features(_seeds(spark, sf_dir, FEW[:1]), db, "customer", "c_custkey", "timestamp", 3, target_col="churn")
    flat = dfs.at_depth(deep, dfs.depths(db, "customer", 3), 2)
    return tidy(_without(flat, "epochtime", "orderstatus"))


def dfs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and count of an entity's strictly earlier labels."""
    db = star(spark, sf_dir, "customer", columns=COLUMNS)
    labels = _seeds(spark, sf_dir, ORDER_ANCHORS[:6])
    out = dfs.features(labels, db, "customer", "c_custkey", "timestamp", 2, history=labels, target_col="churn")
    return tidy(out.select("c_custkey", "timestamp", "`d2__customer.COUNT(_target_history)`", "`d2__customer.MEAN(_target_history.churn)`"))


def dfs_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "orders", columns=COLUMNS)
    seeds = _seeds(spark, sf_dir, ORDER_ANCHORS).drop("churn")
    return tidy(dfs.running_features(seeds, db["orders"], "o_custkey", ["o_totalprice"], "c_custkey", "timestamp", "orders"))


def scalar_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores to probabilities, and a standardised value clamped to its 2nd and 98th percentile."""
    c = star(spark, sf_dir, "customer", columns=COLUMNS)["customer"].df
    z = (F.col("c_acctbal") - F.col("mean")) / F.col("std")
    out = scaling.clamped(c, "c_acctbal", scaling.percentile_bounds(c, "c_acctbal")).crossJoin(F.broadcast(scaling.moments(c, "c_acctbal")))
    return tidy(out.select("c_custkey", sigmoid(z).alias("p"), "clamped"))


QUERIES = {
    f.__name__: f
    for f in (
        feat_entity, feat_calendar, feat_cyclic, feat_temporal_diff, feat_lags_asof, feat_text_lookup, dfs_depth2, dfs_depth3, dfs_depth4,
        dfs_slice, dfs_history, dfs_bucketed, scalar_link,
    )
}

_SEEDS = _churn(FEW)
_DEPTH2 = """
  SELECT s.c_custkey, s.timestamp, round(c.c_acctbal, 4) AS d1__customer_c_acctbal, {extra}
    coalesce(count(o_orderkey), 0)::DOUBLE AS d2__customer_COUNT_orders, round(sum(o_totalprice), 4) AS d2__customer_SUM_orders_o_totalprice,
    round(avg(o_totalprice), 4) AS d2__customer_MEAN_orders_o_totalprice, round(min(o_totalprice), 4) AS d2__customer_MIN_orders_o_totalprice,
    round(max(o_totalprice), 4) AS d2__customer_MAX_orders_o_totalprice, round(stddev_samp(o_totalprice), 4) AS d2__customer_STD_orders_o_totalprice
  FROM s JOIN customer c ON c.c_custkey = s.c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey
  LEFT JOIN orders o ON o_custkey = s.c_custkey AND o_orderdate < s.timestamp
  GROUP BY s.c_custkey, s.timestamp, c_acctbal, c_mktsegment, c_nationkey, n_name, n_regionkey"""

ORACLES = {
    "feat_entity": f"""SELECT epoch_us(timestamp) * 1000.0::DOUBLE AS timestamp, c_acctbal, c_mktsegment, c_nationkey::DOUBLE AS c_nationkey, count(*) AS n
        FROM ({_SEEDS}) JOIN customer USING (c_custkey) GROUP BY 1, 2, 3, 4""",
    "feat_calendar": """SELECT o_orderkey, year(o_orderdate)::DOUBLE AS year, month(o_orderdate)::DOUBLE AS month, day(o_orderdate)::DOUBLE AS day,
          (isodow(o_orderdate) - 1)::DOUBLE AS dayofweek FROM orders""",
    "feat_cyclic": f"""WITH {anchors_cte(ORDER_ANCHORS)} SELECT timestamp,
          round(sin(2 * pi() * month(timestamp) / 12), 4) AS month_sin, round(cos(2 * pi() * month(timestamp) / 12), 4) AS month_cos,
          round(sin(2 * pi() * (isodow(timestamp) - 1) / 7), 4) AS dow_sin, round(cos(2 * pi() * (isodow(timestamp) - 1) / 7), 4) AS dow_cos,
          round(sin(2 * pi() * dayofyear(timestamp) / 365), 4) AS doy_sin, round(cos(2 * pi() * dayofyear(timestamp) / 365), 4) AS doy_cos
        FROM timestamp_df""",
    "feat_temporal_diff": """SELECT o_custkey, TIMESTAMP '2001-01-01' AS timestamp, max(o_totalprice) AS plain,
          (epoch_us(TIMESTAMP '2001-01-01') - epoch_us(max(o_orderdate))) * 1000.0::DOUBLE AS "orders_MAX_o_orderdate_epochtime_diff"
        FROM orders GROUP BY o_custkey""",
    "feat_lags_asof": """WITH pool AS (SELECT o_custkey, o_orderdate AS t, max(o_totalprice) AS label FROM orders GROUP BY ALL),
        ranked AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderdate AS timestamp, label, t,
             row_number() OVER (PARTITION BY o_orderkey ORDER BY t DESC) AS k
           FROM orders o LEFT JOIN pool p ON p.o_custkey = o.o_custkey AND p.t < o.o_orderdate)
        SELECT o_orderkey, o_custkey, timestamp, max(label) FILTER (k = 1) AS total_lag1,
          max(epoch_us(timestamp) - epoch_us(t)) FILTER (k = 1) / 86400000000.0 AS total_lag1_age_days,
          max(label) FILTER (k = 2) AS total_lag2, max(epoch_us(timestamp) - epoch_us(t)) FILTER (k = 2) / 86400000000.0 AS total_lag2_age_days
        FROM ranked GROUP BY ALL""",
    "feat_text_lookup": """SELECT o_orderkey, o_custkey, c_name AS c_name__raw_text, c_mktsegment AS c_mktsegment__raw_text
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "dfs_depth2": f"""WITH s AS (SELECT timestamp, c_custkey FROM ({_SEEDS})),
        modes AS (SELECT c_custkey, timestamp, o_orderstatus, row_number() OVER (PARTITION BY c_custkey, timestamp ORDER BY count(*) DESC, o_orderstatus) AS k
          FROM s JOIN orders ON o_custkey = c_custkey AND o_orderdate < timestamp GROUP BY c_custkey, timestamp, o_orderstatus)
        SELECT f.*, m.o_orderstatus AS d2__customer_MODE_orders_o_orderstatus FROM (""" + _DEPTH2.format(extra="""
          c_mktsegment AS d1__customer_c_mktsegment, n_name AS d2__customer_nation_n_name, n_regionkey::DOUBLE AS d2__customer_nation_n_regionkey,
          nullif(count(DISTINCT o_orderstatus), 0)::DOUBLE AS d2__customer_NUM_UNIQUE_orders_o_orderstatus,
          epoch_us(min(o_orderdate)) * 1000.0::DOUBLE AS d2__customer_MIN_orders_o_orderdate_epochtime,
          epoch_us(max(o_orderdate)) * 1000.0::DOUBLE AS d2__customer_MAX_orders_o_orderdate_epochtime,""")
        + """) f LEFT JOIN modes m ON m.k = 1 AND m.c_custkey = f.c_custkey AND m.timestamp = f.timestamp""",
    "dfs_depth3": f"""WITH s AS (SELECT timestamp, c_custkey FROM ({_churn(FEW[:2])})),
        per AS (SELECT s.c_custkey, s.timestamp, o_orderkey, count(l_orderkey) AS n, sum(l_quantity) AS q, avg(l_quantity) AS a, min(l_quantity) AS lo,
             epoch_us(max(l_shipdate)) * 1000.0::DOUBLE AS last
           FROM s JOIN orders ON o_custkey = s.c_custkey AND o_orderdate < s.timestamp
           LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < s.timestamp GROUP BY ALL)
        SELECT s.c_custkey, s.timestamp, round(max(q), 4) AS "d3__customer_MAX_orders_SUM_lineitem_l_quantity",
          round(sum(n)::DOUBLE, 4) AS "d3__customer_SUM_orders_COUNT_lineitem", round(avg(a), 4) AS "d3__customer_MEAN_orders_MEAN_lineitem_l_quantity",
          round(stddev_samp(lo), 4) AS "d3__customer_STD_orders_MIN_lineitem_l_quantity",
          min(last) AS "d3__customer_MIN_orders_MAX_lineitem_l_shipdate_epochtime"
        FROM s LEFT JOIN per USING (c_custkey, timestamp) GROUP BY s.c_custkey, s.timestamp""",
    "dfs_depth4": f"""WITH {anchors_cte(FEW[:2])},
        o AS (SELECT t.timestamp, o_custkey, o_orderkey, count(l_orderkey)::DOUBLE AS n, sum(l_quantity) AS q
          FROM timestamp_df t JOIN orders ON o_orderdate < t.timestamp LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < t.timestamp
          GROUP BY ALL),
        c AS (SELECT t.timestamp, c_nationkey, c_custkey, sum(n) AS n, max(q) AS q
          FROM timestamp_df t CROSS JOIN customer LEFT JOIN o ON o_custkey = c_custkey AND o.timestamp = t.timestamp GROUP BY ALL)
        SELECT n_nationkey, t.timestamp, round(max(n), 4) AS "d4__nation_MAX_customer_SUM_orders_COUNT_lineitem",
          round(sum(q), 4) AS "d4__nation_SUM_customer_MAX_orders_SUM_lineitem_l_quantity"
        FROM timestamp_df t CROSS JOIN nation LEFT JOIN c ON c_nationkey = n_nationkey AND c.timestamp = t.timestamp GROUP BY ALL""",
    "dfs_slice": f"WITH s AS (SELECT timestamp, c_custkey FROM ({_churn(FEW[:1])})) " + _DEPTH2.format(extra="c_mktsegment AS d1__customer_c_mktsegment, c_nationkey::DOUBLE AS d1__customer_c_nationkey,"),
    "dfs_history": f"""WITH s AS ({_churn(ORDER_ANCHORS[:6])})
        SELECT a.c_custkey, a.timestamp, count(b.churn)::DOUBLE AS "d2__customer_COUNT__target_history",
          round(avg(b.churn), 4) AS "d2__customer_MEAN__target_history_churn"
        FROM s a LEFT JOIN s b ON a.c_custkey = b.c_custkey AND b.timestamp < a.timestamp GROUP BY ALL""",
    "dfs_bucketed": f"""WITH s AS ({_churn(ORDER_ANCHORS)})
        SELECT timestamp, c_custkey, count(o_orderkey)::DOUBLE AS orders_COUNT, round(sum(o_totalprice), 4) AS orders_SUM_o_totalprice,
          round(avg(o_totalprice), 4) AS orders_MEAN_o_totalprice, round(min(o_totalprice), 4) AS orders_MIN_o_totalprice,
          round(max(o_totalprice), 4) AS orders_MAX_o_totalprice, round(stddev_samp(o_totalprice), 4) AS orders_STD_o_totalprice
        FROM s LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < timestamp GROUP BY ALL""",
    "scalar_link": """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, quantile_cont(c_acctbal, 0.02) AS lo, quantile_cont(c_acctbal, 0.98) AS hi FROM customer)
        SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal - m) / s)), 4) AS p, round(greatest(least(c_acctbal, hi), lo), 4) AS clamped FROM customer, s""",
}
ORACLES = {n: re.sub(r"round\((.*?), 4\)", r"(floor((\1) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE)", q, flags=re.S) for n, q in ORACLES.items()}
