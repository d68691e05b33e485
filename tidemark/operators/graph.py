"""Database to heterogeneous temporal graph: edge lists, routes, neighbour and token sampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import int60, quoted
from tidemark.operators.numbering import range_numbered
from tidemark.sources.schema import RelDatabase


@dataclass(frozen=True)
class Route:
    """``dim-dim``: one reference; ``dim-fact-dim``: two references of one table, the table between them."""

    kind: str
    source: str
    target: str
    fact: str | None
    source_col: str
    target_col: str | None


def node_ids(db: RelDatabase, table: str) -> DataFrame:
    """(id, key columns, time): a node per row; keyless tables are numbered along their columns."""
    t = db[table]
    if t.pkey:
        return t.df.withColumn("_node", F.col(quoted(t.pkey)).cast("long"))
    order = [*([t.time_col] if t.time_col else []), *[c for c in t.df.columns if c != t.time_col]]
    return range_numbered(t.df, order).withColumnRenamed("index", "_node")


def edges(db: RelDatabase, table: str, nodes: DataFrame | None = None) -> DataFrame:
    """All edges of a table's references, both ways: (edge_type, src, dst, time); the time is the referring row's."""
    t = db[table]
    rows = node_ids(db, table) if nodes is None else nodes
    at = F.col(quoted(t.time_col)).cast("timestamp_ntz") if t.time_col else F.lit(None).cast("timestamp_ntz")
    out = []
    for column, parent in t.fkeys.items():
        ahead = rows.where(F.col(quoted(column)).isNotNull()).select("_node", F.col(quoted(column)).cast("long").alias("_ref"), at.alias("time"))
        name = f"{table}-f2p_{column}-{parent}"
        back = f"{parent}-rev_f2p_{column}-{table}"
        out.append(ahead.select(F.explode(F.array(
            F.struct(F.lit(name).alias("edge_type"), F.col("_node").alias("src"), F.col("_ref").alias("dst"), "time"),
            F.struct(F.lit(back).alias("edge_type"), F.col("_ref").alias("src"), F.col("_node").alias("dst"), "time"),
        )).alias("e")).select("e.*"))
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def routes(db: RelDatabase) -> list[Route]:
    """Atomic routes from the schema alone.  A reference to its own table is kept apart."""
    out = []
    for name, t in db.tables.items():
        refs = list(t.fkeys.items())
        selfs = [(c, p) for c, p in refs if p == name]
        others = [(c, p) for c, p in refs if p != name]
        for c, p in selfs if others and len(refs) > 1 else []:
            out += [Route("dim-dim", name, p, None, c, None), Route("dim-dim", p, name, None, c, None)]
        pairs = others if len(others) > 1 else []
        for c, p in refs if not pairs and not (selfs and others) else (others if len(others) == 1 else []):
            out += [Route("dim-dim", name, p, None, c, None), Route("dim-dim", p, name, None, c, None)]
        for i, (c1, p1) in enumerate(pairs):
            for j, (c2, p2) in enumerate(pairs):
                if i != j:
                    out.append(Route("dim-fact-dim", p1, p2, name, c1, c2))
    return out


def two_hop(db: RelDatabase, route: Route) -> DataFrame:
    """(src, dst, n, latest): pairs of a dim-fact-dim route through the fact table's rows, aggregated before any join."""
    t = db[route.fact]
    at = F.max(quoted(t.time_col)) if t.time_col else F.lit(None).cast("timestamp_ntz")
    both = t.df.where(F.col(quoted(route.source_col)).isNotNull() & F.col(quoted(route.target_col)).isNotNull())
    return both.groupBy(F.col(quoted(route.source_col)).alias("src"), F.col(quoted(route.target_col)).alias("dst")).agg(
        F.count(F.lit(1)).alias("n"), at.alias("latest")
    )


def neighbours(seeds: DataFrame, graph: DataFrame, fanouts: Sequence[int], seed: int) -> DataFrame:
    """(seed_id, hop, edge_type, src, dst): up to ``fanout`` neighbours a node and edge type, none later than the seed.

    ``seeds`` has seed_id, node_type, node and time; an edge type names its source type before the first dash.  What a node
    shows at a time is drawn once and shared by all seeds that reach it then: a hub's edges are ranked once per time, not
    once per seed, and a seed only ever sees ``fanout`` of them.
    """
    return _sampled(seeds, graph, fanouts, seed).drop("time", "limit")


def _sampled(seeds: DataFrame, graph: DataFrame, fanouts: Sequence[int], seed: int) -> DataFrame:
    frontier = seeds.select("seed_id", "node_type", "node", F.col("time").alias("limit"))
    typed = graph.withColumn("_type", F.element_at(F.split("edge_type", "-"), 1))
    out = None
    for hop, fanout in enumerate(fanouts, 1):
        asked = frontier.select("node_type", "node", "limit").distinct()
        found = asked.join(typed, (F.col("node") == F.col("src")) & (F.col("node_type") == F.col("_type"))).where("time IS NULL OR time <= limit")
        order = W.partitionBy("node_type", "node", "limit", "edge_type").orderBy("_key", "dst")  # as the join has placed them
        drawn = (
            found.withColumn("_key", int60(seed, F.lit(hop), F.col("edge_type"), F.col("src"), F.col("dst")))
            .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fanout)
            .select("node_type", "node", "limit", "edge_type", "src", "dst", "time")
        )
        step = frontier.join(drawn, ["node_type", "node", "limit"]).select("seed_id", F.lit(hop).alias("hop"), "edge_type", "src", "dst", "time", "limit")
        out = step if out is None else out.unionByName(step)
        frontier = step.select("seed_id", F.element_at(F.split("edge_type", "-"), -1).alias("node_type"), F.col("dst").alias("node"), "limit").distinct()
    return out


def tokens(seeds: DataFrame, graph: DataFrame, pool: DataFrame, k: int, seed: int) -> DataFrame:
    """(seed_id, position, node_type, node, hop, rel_days): K tokens a seed.

    Position 0 is the seed; then neighbours within two hops no later than the seed, nearer hops first, drawn by key;
    what is left is filled from ``pool`` (pool_id from 0, node_type, node), a row a missing place, as hop 3.
    """
    sampled = _sampled(seeds, graph, [k, k], seed).select(
        "seed_id", "hop", F.element_at(F.split("edge_type", "-"), -1).alias("node_type"), F.col("dst").alias("node"), "time", "limit"
    )
    own = seeds.select("seed_id", F.lit(0).alias("hop"), "node_type", "node", F.lit(None).cast("timestamp_ntz").alias("time"), F.col("time").alias("limit"))
    # All of a seed stands in one partition from here on, and is read once: its own node at hop 0, its neighbours, its missing places.
    reached = (
        own.unionByName(sampled).repartition("seed_id").groupBy("seed_id", "node_type", "node")
        .agg(F.min("hop").alias("hop"), F.max("time").alias("t"), F.max("limit").alias("limit"))
    )
    order = W.partitionBy("seed_id").orderBy("hop", "_key", "node_type", "node")
    kept = (
        reached.withColumn("_key", int60(seed, F.col("seed_id"), F.col("node_type"), F.col("node")))
        .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        .withColumn("_to", F.when(F.lead("_n").over(order).isNull(), F.lit(k)).otherwise(F.col("_n")))
    )
    size = pool.agg(F.max("pool_id").alias("_top")).select((F.col("_top") + 1).alias("_size"))
    places = (
        kept.crossJoin(F.broadcast(size)).withColumn("_at", F.explode(F.sequence("_n", "_to")))
        .withColumn("position", F.col("_at") - 1).withColumn("_missing", F.col("_at") > F.col("_n"))
        # Places that are taken get keys below any of the pool's, spread so that they don't meet in one task.
        .withColumn("_pick", F.when(F.col("_missing"), F.pmod(int60(seed, "fill", F.col("seed_id"), F.col("position")), F.col("_size")))
                    .otherwise(-1 - F.pmod(F.xxhash64("seed_id", "position"), F.lit(2**40))))
    )
    fill = pool.select(F.col("pool_id").alias("_id"), F.col("node_type").alias("_fill_type"), F.col("node").alias("_fill"))
    filled = places.join(fill, F.col("_missing") & (F.col("_pick") == F.col("_id")), "left").where("NOT _missing OR _id IS NOT NULL")
    days = F.when(F.col("hop") == 0, F.lit(0.0)).otherwise(_days("limit", "t"))
    return filled.select(
        "seed_id", "position", *[F.when(F.col("_missing"), F.col(new)).otherwise(F.col(c)).alias(c) for c, new in (("node_type", "_fill_type"), ("node", "_fill"))],
        F.when(F.col("_missing"), F.lit(3)).otherwise(F.col("hop")).alias("hop"), F.when(~F.col("_missing"), days).alias("rel_days"),
    )


def _days(later: str, earlier: str):
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / 86_400_000_000.0


def global_ids(db: RelDatabase) -> DataFrame:
    """(node_type, offset, n): cumulative offsets of node types in the order of their names; one row a table."""
    counts = None
    for name in sorted(db.tables):
        one = db[name].df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("node_type"), "n")
        counts = one if counts is None else counts.unionByName(one)
    before = W.orderBy("node_type").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("node_type", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "n")


def induced_edges(toks: DataFrame, graph: DataFrame) -> DataFrame:
    """(seed_id, from_position, to_position): edges between tokens of one sequence.

    The pairs of a sequence's tokens, of kinds that some edge joins, are looked up by both ends.  A lookup by one end would
    bring all edges of a hub to each of the seeds that hold it.
    """
    ends = {"_ta": F.element_at(F.split("edge_type", "-"), 1), "_tb": F.element_at(F.split("edge_type", "-"), -1)}
    e = graph.select(*[c.alias(n) for n, c in ends.items()], F.col("src").alias("_a"), F.col("dst").alias("_b"))
    kinds = graph.select("edge_type").distinct().select(*[c.alias(n) for n, c in ends.items()]).distinct()
    whole = toks.where("seed_id IS NOT NULL").groupBy("seed_id").agg(F.collect_list(F.struct("position", "node_type", "node")).alias("_all"))
    pairs = whole.withColumn("_x", F.explode("_all")).withColumn("_y", F.explode("_all")).select(
        "seed_id", F.col("_x.position").alias("from_position"), F.col("_y.position").alias("to_position"),
        F.col("_x.node_type").alias("_ta"), F.col("_x.node").alias("_a"), F.col("_y.node_type").alias("_tb"), F.col("_y.node").alias("_b"),
    )
    found = pairs.join(F.broadcast(kinds), ["_ta", "_tb"], "left_semi").join(e, ["_ta", "_tb", "_a", "_b"], "left_semi")
    return found.select("seed_id", "from_position", "to_position").repartition("seed_id").distinct()


def packed(toks: DataFrame) -> DataFrame:
    """(seed_id, tokens): a row per seed with its tokens by position, as training reads them."""
    fields = [c for c in toks.columns if c != "seed_id"]
    first = ["position", *[c for c in fields if c != "position"]]
    return toks.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct(*[quoted(c) for c in first]))).alias("tokens"))


def unpacked(sequences: DataFrame) -> DataFrame:
    """A row per token again."""
    return sequences.select("seed_id", F.explode("tokens").alias("_t")).select("seed_id", "_t.*")


@dataclass(frozen=True)
class Context:
    """The shape of a context: cells in all, cells about one entity, neighbours a step, and whether the latest go first."""

    size: int
    local: int
    width: int
    latest: bool


# The shapes a context search ranks.
CONTEXT_SIZES = (128, 256, 512, 1024)
CONTEXT_WIDTHS = (16, 64, 256)


def context_grid(sizes: Sequence[int] = CONTEXT_SIZES, widths: Sequence[int] = CONTEXT_WIDTHS) -> list[Context]:
    """All shapes whose local part fits the whole.  Those of one build, which differ in size only, stand together, least size first."""
    builds = product(sizes, widths, (True, False))
    return [Context(size, local, width, latest) for local, width, latest in builds for size in sizes if size >= local]


def check_times(db: RelDatabase, first_year: int = 1900) -> None:
    """Raise where a time lies before any that graph features are made for (an epoch of zero, a parsing slip)."""
    low, _ = db.time_bounds()
    if low is not None and low.year < first_year:
        raise ValueError(f"times before {first_year}: {low}")
