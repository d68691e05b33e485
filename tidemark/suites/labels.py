"""Label queries: every join, subquery, aggregate and window shape that label SQL takes."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import interval_text
from tidemark.operators.labels import run_sql
from tidemark.operators.temporal import anchor_frame, eval_anchors, windows_of
from tidemark.suites.common import star

QUARTER = timedelta(days=91)
ORDER_ANCHORS = eval_anchors(datetime(1996, 1, 1), QUARTER, 20)
EVENT_ANCHORS = eval_anchors(datetime(2024, 1, 4), timedelta(days=2), 12)
THREE_DAYS = timedelta(days=3)

#: name -> (tables, anchors, step, SQL in DuckDB's dialect, SELECT list that fixes types)
LABELS: dict[str, tuple[tuple[str, ...], list[datetime], timedelta, str]] = {
    "label_customer_decline": (("customer", "orders"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, c_custkey,
               CAST(COALESCE(SUM(CASE WHEN o_orderdate > timestamp THEN o_totalprice END), 0)
                    < 0.5 * SUM(CASE WHEN o_orderdate <= timestamp THEN o_totalprice END) AS INTEGER) AS churn
        FROM timestamp_df
        JOIN orders ON o_orderdate > timestamp - INTERVAL '{timedelta}' AND o_orderdate <= timestamp + INTERVAL '{timedelta}'
        JOIN customer ON c_custkey = o_custkey
        GROUP BY timestamp, c_custkey HAVING COUNT(CASE WHEN o_orderdate <= timestamp THEN 1 END) > 0"""),
    "label_customer_quiet": (("customer", "orders"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, c_custkey,
               CAST(NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_custkey = c_custkey AND n.o_orderstatus = 'F'
                                AND n.o_orderdate BETWEEN timestamp + INTERVAL '1 days' AND timestamp + INTERVAL '{timedelta}') AS INTEGER) AS quiet
        FROM customer, timestamp_df
        WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c_custkey AND p.o_totalprice > 150000
                                        AND p.o_orderdate <= timestamp)"""),
    "label_part_restocked": (("part", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, p_partkey,
               CAST(EXISTS (SELECT 1 FROM lineitem s WHERE s.l_partkey = p_partkey AND s.l_quantity >= 30
                            AND s.l_shipdate > timestamp AND s.l_shipdate <= timestamp + INTERVAL '{timedelta}') AS INTEGER) AS restocked
        FROM part CROSS JOIN timestamp_df
        WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = p_partkey AND r.l_returnflag = 'R'
                                          AND r.l_shipdate > timestamp - INTERVAL '30 days' AND r.l_shipdate <= timestamp)"""),
    "label_part_ltv": (("part", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, p_partkey, COALESCE(SUM(l_extendedprice), 0) AS ltv
        FROM timestamp_df, part, lineitem
        WHERE l_partkey = p_partkey AND l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, p_partkey"""),
    "label_customer_peak_lateral": (("customer", "orders", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, c_custkey, peak
        FROM customer, timestamp_df,
             (SELECT COALESCE(MAX(l_quantity), 0) AS peak FROM orders JOIN lineitem ON l_orderkey = o_orderkey
              WHERE o_custkey = c_custkey AND l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}')
        WHERE c_mktsegment = 'BUILDING'"""),
    "label_part_discounted_lateral": (("part", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, p_partkey, n_discounted
        FROM part, timestamp_df,
             (SELECT COUNT(*) AS n_discounted FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.05
              AND l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}')
        WHERE p_size <= 20"""),
    "label_ctr_ratio_having": (("part", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, l_partkey, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / COUNT(l_orderkey) AS rate
        FROM timestamp_df LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey)
          ON l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, l_partkey HAVING SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0"""),
    "label_nested_join_clicks": (("customer", "orders", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, j.c_custkey, COUNT(j.l_linenumber) > 1 AS clicked
        FROM timestamp_df LEFT JOIN
             (SELECT c_custkey, l_linenumber, l_shipdate FROM (customer JOIN orders ON c_custkey = o_custkey) JOIN lineitem ON l_orderkey = o_orderkey) j
          ON j.l_shipdate > timestamp AND j.l_shipdate <= timestamp + INTERVAL '{timedelta}'
        WHERE j.c_custkey IS NOT NULL
        GROUP BY timestamp, j.c_custkey"""),
    "label_distinct_visits": (("orders", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, o_custkey, COUNT(DISTINCT l_suppkey) > 2 AS many
        FROM timestamp_df LEFT JOIN (orders JOIN lineitem ON l_orderkey = o_orderkey)
          ON l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, o_custkey"""),
    "label_event_range_left": (("events",), EVENT_ANCHORS, THREE_DAYS, """
        SELECT timestamp, user_id, SUM(CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END) AS n_active
        FROM timestamp_df LEFT JOIN events ON ts > timestamp AND ts <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, user_id"""),
    "label_event_ignore_having": (("events",), EVENT_ANCHORS, THREE_DAYS, """
        SELECT timestamp, user_id, CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) > 2 AS INTEGER) AS ignored
        FROM timestamp_df LEFT JOIN events ON ts > timestamp AND ts <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, user_id HAVING user_id IS NOT NULL AND NOT (COUNT(*) < 2)"""),
    "label_event_burst_window": (("events",), EVENT_ANCHORS, THREE_DAYS, """
        WITH windows AS (
          SELECT timestamp, user_id, COUNT(*) AS n_in, SUM(COUNT(*)) OVER (PARTITION BY user_id ORDER BY timestamp) AS so_far
          FROM timestamp_df JOIN events ON ts > timestamp AND ts <= timestamp + INTERVAL '{timedelta}'
          GROUP BY timestamp, user_id)
        SELECT timestamp, user_id, CAST(2 * n_in > so_far AS INTEGER) AS burst FROM windows
        WHERE (n_in >= 3 OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = windows.user_id AND e.event_type = 'purchase' AND e.ts <= timestamp))
              AND so_far < (SELECT COUNT(*) FROM events whole)"""),
    "label_supplier_returns_in": (("supplier", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, s_suppkey, COUNT(l_orderkey) AS n_returned
        FROM supplier CROSS JOIN timestamp_df
        LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        WHERE s_suppkey IN (SELECT DISTINCT big.l_suppkey FROM lineitem big WHERE big.l_quantity > 40 AND big.l_shipdate <= timestamp)
        GROUP BY timestamp, s_suppkey"""),
    "label_supplier_lot_mean": (("supplier", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, l_suppkey, mean(l_quantity) AS lot
        FROM timestamp_df JOIN lineitem ON l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)
        GROUP BY timestamp, l_suppkey"""),
    "label_part_small_lot": (("part", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, p_partkey, CASE WHEN MIN(l_quantity) <= 5 THEN 1 ELSE 0 END AS small_lot
        FROM timestamp_df JOIN lineitem ON l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        JOIN part ON p_partkey = l_partkey
        GROUP BY timestamp, p_partkey"""),
    "label_theta_votes": (("orders", "lineitem"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, o_orderkey, COUNT(DISTINCT l_linenumber) AS votes
        FROM timestamp_df LEFT JOIN orders ON o_orderdate <= timestamp AND o_orderstatus != 'P'
        LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, o_orderkey"""),
    "label_badge_having": (("customer", "orders"), ORDER_ANCHORS, QUARTER, """
        SELECT timestamp, c_custkey, CASE WHEN COUNT(o_orderkey) >= 1 THEN 1 ELSE 0 END AS badge
        FROM timestamp_df LEFT JOIN customer ON c_acctbal > 0
        LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate > timestamp AND o_orderdate <= timestamp + INTERVAL '{timedelta}'
        GROUP BY timestamp, c_custkey HAVING c_custkey IS NOT NULL"""),
    "label_engagement_union": (("orders", "events", "customer"), ORDER_ANCHORS, QUARTER, """
        WITH activity AS (
          SELECT o_custkey AS uid, o_orderdate AS moment FROM orders
          UNION SELECT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'
          UNION SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
        active AS (
          SELECT t.timestamp, c.c_custkey, COUNT(DISTINCT a.moment) AS n_acts
          FROM timestamp_df t CROSS JOIN customer c LEFT JOIN activity a
            ON a.uid = c.c_custkey AND a.moment > t.timestamp AND a.moment <= t.timestamp + INTERVAL '{timedelta}'
          WHERE c.c_custkey IN (SELECT uid FROM activity WHERE moment <= t.timestamp)
          GROUP BY t.timestamp, c.c_custkey)
        SELECT timestamp, c_custkey, IF(n_acts >= 1, 1, 0) AS engaged FROM active"""),
    "label_success_stacked_on": (("orders", "lineitem", "part"), ORDER_ANCHORS, QUARTER, """
        WITH good AS (
          SELECT t.timestamp, l.l_suppkey, MAX(CASE WHEN l.l_returnflag = 'N' AND p.p_size > 10 THEN 1 ELSE 0 END) AS ok, o.o_orderkey
          FROM timestamp_df t LEFT JOIN lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey
            ON l.l_shipdate > t.timestamp AND l.l_shipdate <= t.timestamp + INTERVAL '{timedelta}'
          LEFT JOIN part p ON p.p_partkey = l.l_partkey
          GROUP BY t.timestamp, l.l_suppkey, o.o_orderkey)
        SELECT timestamp, l_suppkey, SUM(ok) / COUNT(ok) AS success FROM good
        WHERE l_suppkey IS NOT NULL GROUP BY timestamp, l_suppkey"""),
    "label_two_level_sum": (("orders", "lineitem"), ORDER_ANCHORS, QUARTER, """
        WITH per_order AS (
          SELECT l_orderkey, SUM(l_quantity) AS quantity, MIN(l_shipdate) AS at FROM lineitem GROUP BY l_orderkey)
        SELECT t.timestamp, o.o_custkey, SUM(r.quantity) AS total
        FROM timestamp_df t LEFT JOIN per_order r ON r.at > t.timestamp AND r.at <= t.timestamp + INTERVAL '{timedelta}'
        LEFT JOIN orders o ON o.o_orderkey = r.l_orderkey
        GROUP BY t.timestamp, o.o_custkey"""),
    "label_outcome_min": (("orders", "lineitem", "part"), ORDER_ANCHORS, QUARTER, """
        WITH tests AS (
          SELECT o.o_custkey, l.l_discount AS p_value, l.l_shipdate AS at
          FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey
          WHERE p.p_size IS NOT NULL AND l.l_discount >= 0)
        SELECT t.timestamp, x.o_custkey, CASE WHEN MIN(x.p_value) <= 0.02 THEN 1 ELSE 0 END AS outcome
        FROM timestamp_df t LEFT JOIN tests x ON x.at > t.timestamp AND x.at <= t.timestamp + INTERVAL '{timedelta}'
        GROUP BY t.timestamp, x.o_custkey"""),
    "label_literal_braces": (("events",), EVENT_ANCHORS, THREE_DAYS, """
        SELECT timestamp, user_id, COUNT(*) AS n
        FROM timestamp_df, events
        WHERE ts > timestamp AND ts <= timestamp + INTERVAL '{timedelta}' AND ts >= TIMESTAMP '2024-01-02 00:00:00'
          AND (props LIKE '{"k": %}' OR props LIKE '{"k":%}')
        GROUP BY timestamp, user_id"""),
}

#: Target types that both engines are brought to.
_KINDS = {
    "n_active": "bigint", "n": "bigint", "votes": "bigint", "churn": "int", "quiet": "int", "restocked": "int", "burst": "int", "badge": "int", "small_lot": "int",
    "n_returned": "bigint", "n_discounted": "bigint", "ltv": "double", "peak": "double", "lot": "double",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, anchors, step, sql = LABELS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_sql(spark, star(spark, sf_dir, *tables), anchor_frame(spark, anchors), sql, step)
        return out.select(*[F.col(c).cast(_KINDS[c]).alias(c) if c in _KINDS else F.col(c) for c in out.columns])

    return run


def anchors_cte(anchors: list[datetime]) -> str:
    rows = ", ".join(f"(TIMESTAMP '{a}')" for a in anchors)
    return f"timestamp_df AS (SELECT * FROM (VALUES {rows}) v(timestamp))"


def _oracle(name: str) -> str:
    _, anchors, step, sql = LABELS[name]
    body = sql.replace("{timedelta}", interval_text(step)).strip()
    body = f"WITH {anchors_cte(anchors)}, {body[5:]}" if body.startswith("WITH ") else f"WITH {anchors_cte(anchors)} {body}"
    casts = [f"CAST({c} AS {k}) AS {c}" for c, k in _KINDS.items() if re.search(rf"\bAS {c}\b", sql)]
    replaced = ", ".join(casts)
    return f"SELECT * REPLACE ({replaced}) FROM ({body})" if replaced else body


def label_windows_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of sales per part and window without a join: each line item finds its windows inside its own row."""
    items = star(spark, sf_dir, "lineitem", columns={"lineitem": ("l_partkey", "l_extendedprice", "l_shipdate")})["lineitem"].df
    return (
        windows_of(items, "l_shipdate", ORDER_ANCHORS, QUARTER)
        .groupBy("timestamp", "l_partkey").agg(F.sum("l_extendedprice").alias("ltv"))
    )


QUERIES = {n: _query(n) for n in LABELS} | {"label_windows_native": label_windows_native}
ORACLES = {n: _oracle(n) for n in LABELS} | {
    "label_windows_native": f"""WITH {anchors_cte(ORDER_ANCHORS)}
        SELECT timestamp, l_partkey, SUM(l_extendedprice) AS ltv FROM timestamp_df, lineitem
        WHERE l_shipdate > timestamp AND l_shipdate <= timestamp + INTERVAL '91 days' GROUP BY timestamp, l_partkey""",
}
