"""Edges between the tokens of a sequence where one node has most of the edges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph

AT = datetime(2020, 1, 1)
TOKENS = "seed_id long, position int, node_type string, node long, hop int, rel_days double"
EDGES = "edge_type string, src long, dst long, time timestamp_ntz"


def rows_of_joins(df, spark):
    """Rows that each join of the plan made, by running it."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df.collect()
        found, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found
    finally:
        spark.conf.set(key, before)


def test__induced_edges__hub__joins_make_a_row_per_pair_of_tokens_at_most(spark):
    n = 300
    people = spark.range(n)
    seeds = people.select(F.col("id").alias("seed_id"), F.lit("person").alias("node_type"), F.col("id").alias("node"))
    toks = seeds.selectExpr("seed_id", "0 AS position", "node_type", "node").union(seeds.selectExpr("seed_id", "1", "'town'", "0L"))
    edges = people.selectExpr("'person-f2p_town-town' AS edge_type", "id AS src", "0L AS dst").union(
        people.selectExpr("'town-rev_f2p_town-person'", "0L", "id"))
    out = graph.induced_edges(toks, edges)
    assert max(rows_of_joins(out, spark)) <= 4 * n  # all edges of the town for each seed were 90,000
    assert {tuple(r) for r in out.collect()} == {(i, *p) for i in range(n) for p in ((0, 1), (1, 0))}


def test__induced_edges__loops_repeats_and_other_kinds__equal_plain_pairs(spark):
    toks = [
        (1, 0, "a", 1, 0, 0.0), (1, 1, "b", 1, 1, None), (1, 2, "b", 1, 3, None), (1, 3, "a", 2, 2, None),
        (2, 0, "a", 2, 0, 0.0), (2, 1, "c", 1, 1, None), (2, 2, "b", None, 1, None), (None, 0, "a", 1, 0, 0.0), (None, 1, "b", 1, 1, None),
    ]
    edges = [("a-f2p_x-b", 1, 1, AT), ("a-f2p_y-b", 1, 1, None), ("a-f2p_x-b", 1, 1, AT), ("a-f2p_z-a", 2, 2, None), ("b-rev_f2p_x-a", 1, 2, AT), ("a-f2p_x-b", 2, None, AT)]
    known = {(e[0].split("-")[0], e[1], e[0].split("-")[-1], e[2]) for e in edges if None not in e[1:3]}
    want = {(x[0], x[1], y[1]) for x in toks for y in toks if x[0] is not None and x[0] == y[0] and (x[2], x[3], y[2], y[3]) in known}
    got = [tuple(r) for r in graph.induced_edges(spark.createDataFrame(toks, TOKENS), spark.createDataFrame(edges, EDGES)).collect()]
    assert len(got) == len(set(got)) and set(got) == want == {(1, 0, 1), (1, 0, 2), (1, 3, 3), (1, 1, 3), (1, 2, 3), (2, 0, 0)}


@pytest.mark.parametrize("pool", [[(0, "t", 7), (1, "t", 8)], []])
def test__tokens__few_or_no_neighbours__own_first_then_the_pool(spark, pool):
    seeds = spark.createDataFrame([(1, "a", 1, AT), (2, "a", 2, AT)], "seed_id long, node_type string, node long, time timestamp_ntz")
    edges = spark.createDataFrame([
        ("a-f2p_x-b", 1, 5, datetime(2019, 12, 31)), ("b-rev_f2p_x-a", 5, 1, datetime(2019, 12, 31)), ("a-f2p_x-b", 2, 6, datetime(2020, 1, 2))], EDGES)
    got = graph.tokens(seeds, edges, spark.createDataFrame(pool, "pool_id long, node_type string, node long"), 4, 3).collect()
    by = {(r.seed_id, r.position): r for r in got}
    assert len(by) == len(got) == (8 if pool else 3)
    assert {k: tuple(r)[2:] for k, r in by.items() if r.hop < 3} == {(1, 0): ("a", 1, 0, 0.0), (1, 1): ("b", 5, 1, 1.0), (2, 0): ("a", 2, 0, 0.0)}
    assert all(r.node_type == "t" and r.node in (7, 8) and r.rel_days is None for r in got if r.hop == 3)


def test__tokens__in_a_plan__neighbours_are_drawn_once(spark):
    seeds = spark.createDataFrame([(1, "a", 1, AT)], "seed_id long, node_type string, node long, time timestamp_ntz")
    pool = spark.createDataFrame([(0, "t", 7)], "pool_id long, node_type string, node long")
    toks = graph.tokens(seeds, spark.createDataFrame([("a-f2p_x-b", 1, 5, AT)], EDGES), pool, 4, 3)
    plan = toks._jdf.queryExecution().optimizedPlan().toString()
    drawn = graph.neighbours(seeds, spark.createDataFrame([("a-f2p_x-b", 1, 5, AT)], EDGES), [4, 4], 3)._jdf.queryExecution().optimizedPlan().toString()
    draws = lambda text: sum("Window [row_number()" in x and "edge_type" in x for x in text.splitlines())
    assert draws(plan) == draws(drawn) > 0
