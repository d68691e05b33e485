"""Graph and sink queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.suites.common import star

SEED = 11
AT = datetime(1999, 6, 1)
_COLUMNS = {"orders": ("o_orderkey", "o_custkey", "o_orderdate"), "customer": ("c_custkey", "c_nationkey")}


def _orders(spark: SparkSession, sf_dir: str):
    return star(spark, sf_dir, "customer", "nation", "orders", columns=_COLUMNS)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    return graph.edges(db, "orders").unionByName(graph.edges(db, "customer"))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _orders(spark, sf_dir)["customer"].df
    return customers.select(
        F.col("c_custkey").alias("seed_id"), F.lit("customer").alias("node_type"), F.col("c_custkey").alias("node"), F.lit(AT).cast("timestamp_ntz").alias("time")
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)


def graph_keyless_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the keyless line items, whose nodes are numbered: counts per type and target."""
    db = star(spark, sf_dir, "orders", "part", "lineitem", columns={"lineitem": ("l_orderkey", "l_partkey", "l_shipdate")})
    e = graph.edges(db, "lineitem")
    return e.where("edge_type LIKE 'lineitem%'").groupBy("edge_type", "dst").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_src"))


def graph_global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.global_ids(_orders(spark, sf_dir))


def atomic_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "customer", "nation", "orders", "part", "supplier", "lineitem")
    rows = [(r.kind, r.source, r.target, r.fact, r.source_col) for r in graph.routes(db)]
    return spark.createDataFrame(rows, "kind string, source string, target string, fact string, source_col string")


def atomic_routes_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = star(spark, sf_dir, "part", "supplier", "lineitem")
    route = next(r for r in graph.routes(db) if r.kind == "dim-fact-dim" and r.source == "part")
    return graph.two_hop(db, route)


def neighbor_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbours(_seeds(spark, sf_dir), _graph(spark, sf_dir), [4, 2], SEED)


def tokens_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _orders(spark, sf_dir)["nation"].df.select(F.col("n_nationkey").cast("long").alias("pool_id"), F.lit("nation").alias("node_type"), F.col("n_nationkey").cast("long").alias("node"))
    return graph.tokens(_seeds(spark, sf_dir), _graph(spark, sf_dir), pool, 6, SEED)


def token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced_edges(tokens_k(spark, sf_dir), _graph(spark, sf_dir)).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (graph_edges, graph_keyless_edges, graph_global_ids, atomic_routes, atomic_routes_two_hop, neighbor_sample, tokens_k, token_edges)
}

_EDGES = """
  SELECT 'orders-f2p_o_custkey-customer' AS edge_type, o_orderkey AS src, o_custkey AS dst, o_orderdate AS time FROM orders
  UNION ALL SELECT 'customer-rev_f2p_o_custkey-orders', o_custkey, o_orderkey, o_orderdate FROM orders
  UNION ALL SELECT 'customer-f2p_c_nationkey-nation', c_custkey, c_nationkey, NULL FROM customer
  UNION ALL SELECT 'nation-rev_f2p_c_nationkey-customer', c_nationkey, c_custkey, NULL FROM customer"""
_KEY = "('0x' || substr(md5({}), 1, 15))::BIGINT"
# A node's neighbours at a time are drawn once, whichever seed asks for them.
_RANKED = """SELECT *, row_number() OVER (PARTITION BY edge_type, src ORDER BY """ + _KEY.format(
    f"'{SEED}:' || {{hop}} || ':' || edge_type || ':' || src || ':' || dst"
) + """, dst) AS k FROM edges WHERE time IS NULL OR time <= TIMESTAMP '1999-06-01'"""


def _sample(fan: tuple[int, int]) -> str:
    hop = "SELECT seed_id, edge_type, src, dst, time FROM {} f JOIN d{} d ON d.src = f.node AND split_part(edge_type, '-', 1) = f.node_type WHERE k <= {}"
    return f"""edges AS ({_EDGES}), d1 AS ({_RANKED.format(hop=1)}), d2 AS ({_RANKED.format(hop=2)}),
  f0 AS (SELECT c_custkey AS seed_id, 'customer' AS node_type, c_custkey AS node FROM customer),
  h1 AS ({hop.format("f0", 1, fan[0])}),
  f1 AS (SELECT DISTINCT seed_id, split_part(edge_type, '-', 3) AS node_type, dst AS node FROM h1),
  h2 AS ({hop.format("f1", 2, fan[1])})"""


_TOKENS = f"""{_sample((6, 6))},
  reached AS (SELECT seed_id, split_part(edge_type, '-', 3) AS node_type, dst AS node, min(hop) AS hop, max(time) AS t
    FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2, 3),
  near AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY hop, {_KEY.format(f"'{SEED}:' || seed_id || ':' || node_type || ':' || node")}, node_type, node) AS position
    FROM reached WHERE NOT (node_type = 'customer' AND node = seed_id)),
  kept AS (SELECT * FROM near WHERE position < 6),
  have AS (SELECT f0.seed_id, count(kept.seed_id) AS n FROM f0 LEFT JOIN kept USING (seed_id) GROUP BY 1),
  gaps AS (SELECT seed_id, unnest(generate_series(n + 1, 5)) AS position FROM have WHERE n < 5),
  toks AS (
    SELECT seed_id, 0 AS position, 'customer' AS node_type, seed_id AS node, 0 AS hop, 0.0::DOUBLE AS rel_days FROM f0
    UNION ALL SELECT seed_id, position, node_type, node, hop, (epoch_us(TIMESTAMP '1999-06-01') - epoch_us(t)) / 86400000000.0::DOUBLE FROM kept
    UNION ALL SELECT seed_id, position, 'nation', {_KEY.format(f"'{SEED}:fill:' || seed_id || ':' || position")} % (SELECT max(n_nationkey) + 1 FROM nation), 3, NULL FROM gaps)"""

ORACLES = {
    "graph_edges": _EDGES,
    "graph_keyless_edges": """SELECT 'lineitem-f2p_l_orderkey-orders' AS edge_type, l_orderkey AS dst, count(*) AS n, count(*) AS n_src FROM lineitem GROUP BY 2
        UNION ALL SELECT 'lineitem-f2p_l_partkey-part', l_partkey, count(*), count(*) FROM lineitem GROUP BY 2""",
    "graph_global_ids": """WITH c AS (SELECT 'customer' AS node_type, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation
        UNION ALL SELECT 'orders', count(*) FROM orders) SELECT node_type, (sum(n) OVER (ORDER BY node_type) - n)::BIGINT AS "offset", n FROM c""",
    "atomic_routes": """SELECT * FROM (VALUES
        ('dim-dim', 'customer', 'nation', NULL, 'c_nationkey'), ('dim-dim', 'nation', 'customer', NULL, 'c_nationkey'),
        ('dim-dim', 'orders', 'customer', NULL, 'o_custkey'), ('dim-dim', 'customer', 'orders', NULL, 'o_custkey'),
        ('dim-dim', 'supplier', 'nation', NULL, 's_nationkey'), ('dim-dim', 'nation', 'supplier', NULL, 's_nationkey'),
        ('dim-fact-dim', 'orders', 'part', 'lineitem', 'l_orderkey'), ('dim-fact-dim', 'orders', 'supplier', 'lineitem', 'l_orderkey'),
        ('dim-fact-dim', 'part', 'orders', 'lineitem', 'l_partkey'), ('dim-fact-dim', 'part', 'supplier', 'lineitem', 'l_partkey'),
        ('dim-fact-dim', 'supplier', 'orders', 'lineitem', 'l_suppkey'), ('dim-fact-dim', 'supplier', 'part', 'lineitem', 'l_suppkey')
        ) v(kind, source, target, fact, source_col)""",
    "atomic_routes_two_hop": "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY 1, 2",
    "neighbor_sample": f"""WITH {_sample((4, 2))} SELECT seed_id, 1 AS hop, edge_type, src, dst FROM h1
        UNION ALL SELECT seed_id, 2, edge_type, src, dst FROM h2""",
    "tokens_k": f"WITH {_TOKENS} SELECT seed_id, position::INTEGER AS position, node_type, node::BIGINT AS node, hop::INTEGER AS hop, rel_days FROM toks",
    "token_edges": f"""WITH {_TOKENS}, d AS (SELECT DISTINCT a.seed_id, a.position AS x, b.position AS y
          FROM toks a JOIN edges e ON e.src = a.node AND split_part(edge_type, '-', 1) = a.node_type
          JOIN toks b ON b.seed_id = a.seed_id AND b.node = e.dst AND split_part(edge_type, '-', 3) = b.node_type)
        SELECT seed_id, count(*) AS n FROM d GROUP BY seed_id""",
}
