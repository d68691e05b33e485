"""Label SQL that joins the anchors with data by a range of times, at sizes where Spark must not broadcast the data."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators.labels import run_sql, too_large
from tidemark.operators.temporal import anchor_frame
from tidemark.plans.dialect import broadcast_kept, merge_joined
from tidemark.sources.schema import RelDatabase, RelTable
from tidemark.suites import labels

T = lambda m, d=1, y=2020: datetime(y, m, d)


@pytest.fixture
def small_broadcasts(spark):
    """The smallest tables are then over the threshold, as large ones are over the usual one."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1k")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["label_outcome_min", "label_ctr_ratio_having", "label_distinct_visits"])
def test__range_left_join__data_over_the_threshold__broadcasts_the_anchors(name, spark, data, small_broadcasts):
    plan = labels.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildLeft, LeftOuter" in plan
    assert "BroadcastNestedLoopJoin BuildRight" not in plan


def test__range_left_join__anchors_without_rows__stay(spark, small_broadcasts):
    rows = [(i % 2, T(1 + i)) for i in range(4)] + [(None, T(2))]
    db = RelDatabase({"visits": RelTable(spark.createDataFrame(rows, "who long, t timestamp_ntz"), None, {}, "t")})
    got = run_sql(spark, db, anchor_frame(spark, [T(1), T(6), T(3)]), """
        SELECT timestamp, who, COUNT(t) AS n FROM timestamp_df LEFT JOIN visits ON t > timestamp AND t <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, who""", timedelta(days=60))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(T(1), 0, 1), (T(1), 1, 1), (T(1), None, 1), (T(3), 1, 1), (T(6), None, 0)], key=repr)


def test__anchors__fractions_repeats_and_none__stay(spark):
    at = datetime(2020, 1, 1, 2, 3, 4, 567)
    frame = anchor_frame(spark, [at, at, datetime(1, 1, 1)])
    assert frame.dtypes == [("timestamp", "timestamp_ntz")]
    assert [r.timestamp for r in frame.collect()] == [at, at, datetime(1, 1, 1)]
    assert anchor_frame(spark, []).collect() == [] and anchor_frame(spark, []).columns == ["timestamp"]


@pytest.fixture
def no_broadcasts(spark):
    """Spark then broadcasts by hints alone, or where a join has no other way."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["label_ctr_ratio_having", "label_distinct_visits"])
def test__range_left_join__threshold_off__broadcasts_the_anchors(name, spark, data, no_broadcasts):
    plan = labels.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildLeft, LeftOuter" in plan
    assert "BroadcastNestedLoopJoin BuildRight" not in plan


def test__range_left_join__data_under_the_threshold__broadcasts_the_anchors(spark):
    visits = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ '2020-01-02 00:00:00') AS v(who, t)")
    db = RelDatabase({"visits": RelTable(visits, None, {}, "t")})
    got = run_sql(spark, db, anchor_frame(spark, [T(1), T(6)]), "SELECT timestamp, who FROM timestamp_df LEFT JOIN visits ON t > timestamp", timedelta(days=1))
    assert "BroadcastNestedLoopJoin BuildLeft, LeftOuter" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("joined", [
    "timestamp_df LEFT JOIN visits ON", "timestamp_df AS a LEFT OUTER JOIN visits v ON", "visits RIGHT JOIN timestamp_df ON",
    "visits v RIGHT OUTER JOIN Timestamp_DF a ON", "(timestamp_df a LEFT JOIN (visits JOIN (SELECT 1 AS one) ON one = 1) ON"])
def test__anchors_kept_by_an_outer_join__threshold_off__are_broadcast_and_stay(joined, spark, no_broadcasts):
    rows = [(i % 2, T(1 + i)) for i in range(4)] + [(None, T(2))]
    db = RelDatabase({"visits": RelTable(spark.createDataFrame(rows, "who long, t timestamp_ntz"), None, {}, "t")})
    close = ")" * (joined.count("(") - joined.count(")"))
    got = run_sql(spark, db, anchor_frame(spark, [T(1), T(6), T(3)]), f"""
        SELECT timestamp, who, COUNT(t) AS n FROM {joined} t > timestamp AND t <= timestamp + INTERVAL '{{timedelta}}'{close}
        GROUP BY timestamp, who""", timedelta(days=60))
    plan = got._jdf.queryExecution().executedPlan().toString()
    anchors_first = "LEFT" in joined
    assert f"BroadcastNestedLoopJoin {'BuildLeft, LeftOuter' if anchors_first else 'BuildRight, RightOuter'}" in plan
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(T(1), 0, 1), (T(1), 1, 1), (T(1), None, 1), (T(3), 1, 1), (T(6), None, 0)], key=repr)


@pytest.mark.parametrize("sql", [
    "SELECT a FROM timestamp_df t JOIN x ON a", "SELECT a FROM x LEFT JOIN timestamp_df ON a", "SELECT a FROM timestamp_df t LEFT SEMI JOIN x ON a",
    "SELECT a FROM timestamp_df CROSS JOIN c LEFT JOIN x ON a", "SELECT 'FROM timestamp_df LEFT JOIN x' -- FROM timestamp_df LEFT JOIN x"])
def test__broadcast_hint__anchors_not_kept_or_not_alone__none(sql):
    assert broadcast_kept(sql, "timestamp_df") == sql


def test__broadcast_hint__each_select__its_own():
    sql = "WITH q AS (SELECT 1 FROM timestamp_df t LEFT JOIN x ON a) SELECT (SELECT 2 FROM y) FROM (timestamp_df LEFT JOIN q ON b)"
    assert broadcast_kept(sql, "timestamp_df") == (
        "WITH q AS (SELECT /*+ BROADCAST(t) */ 1 FROM timestamp_df t LEFT JOIN x ON a) "
        "SELECT /*+ BROADCAST(timestamp_df) */ (SELECT 2 FROM y) FROM (timestamp_df LEFT JOIN q ON b)")


def test__distinct_count_over_kept_anchors__threshold_off__counts_once_and_keeps_anchors(spark, no_broadcasts):
    orders = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "o_orderkey long, o_custkey long")
    items = spark.createDataFrame(
        [(1, 5, T(1, 2)), (1, 5, T(1, 3)), (1, 6, T(1, 4)), (2, 9, T(1, 5)), (3, 5, T(1, 6)), (3, None, T(1, 7)), (4, 1, T(1, 8)), (2, 3, T(5))],
        "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz")
    db = RelDatabase({"orders": RelTable(orders, None, {}, None), "lineitem": RelTable(items, None, {}, "l_shipdate")})
    got = run_sql(spark, db, anchor_frame(spark, [T(1), T(9)]), labels.LABELS["label_distinct_visits"][3], timedelta(days=91))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildLeft, LeftOuter" in plan and "BroadcastNestedLoopJoin BuildRight" not in plan
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(T(1), 7, True), (T(1), 8, False), (T(9), None, False)], key=repr)


@pytest.fixture
def large_broadcasts(spark):
    """Spark then broadcasts tables whose hash tables the driver may have no room for."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    yield
    spark.conf.set(key, before)


def visits_of(spark, n_orders):
    orders = spark.range(n_orders).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus")
    items = spark.range(20_000_000).selectExpr("id % 5 AS l_orderkey", "id AS l_suppkey", "TIMESTAMP_NTZ '2020-01-02 00:00:00' AS l_shipdate")
    return RelDatabase({"orders": RelTable(orders, None, {}, None), "lineitem": RelTable(items, None, {}, "l_shipdate")})


@pytest.mark.parametrize("n_orders, join", [(3_000_000, "SortMergeJoin [o_orderkey"), (1000, "BroadcastHashJoin [o_orderkey")])
def test__orders_under_a_high_threshold__broadcast_up_to_the_default_only(n_orders, join, spark, large_broadcasts):
    got = run_sql(spark, visits_of(spark, n_orders), anchor_frame(spark, [T(1)]), labels.LABELS["label_distinct_visits"][3], timedelta(days=91))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "BroadcastNestedLoopJoin BuildLeft, LeftOuter" in plan


def test__tables_too_large__named_columns_and_threshold__decide(spark, large_broadcasts):
    db, sql = visits_of(spark, 3_000_000), labels.LABELS["label_distinct_visits"][3]
    assert too_large(spark, db, sql) == ["orders"]
    assert too_large(spark, db, "SELECT 1 FROM lineitem") == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert too_large(spark, db, sql) == []


@pytest.mark.parametrize("name", [n for n in labels.LABELS])
def test__label_sql__merge_hints_on_all_tables__same_rows(name, spark, data, monkeypatch):
    plain = labels.QUERIES[name](spark, data)
    monkeypatch.setattr("tidemark.operators.labels.too_large", lambda _, db, __: list(db.tables))
    hinted = labels.QUERIES[name](spark, data)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, hinted.collect()))


def test__merge_hint__each_select__its_tables_by_alias():
    sql = "SELECT a, orders.b FROM c JOIN (Orders JOIN lineitem l ON x) ON y WHERE EXISTS (SELECT 1 FROM orders AS n, orders m WHERE z)"
    assert merge_joined(sql, ["orders", "lineitem"]) == (
        "SELECT /*+ MERGE(Orders) */ /*+ MERGE(l) */ a, orders.b FROM c JOIN (Orders JOIN lineitem l ON x) ON y "
        "WHERE EXISTS (SELECT /*+ MERGE(n) */ /*+ MERGE(m) */ 1 FROM orders AS n, orders m WHERE z)")
    assert merge_joined(sql, []) == sql
