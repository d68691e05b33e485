"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition to a spanning star forest of them, block by block: (node, root) with root < node."""

    def flush(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        moved = root != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= 1 << 20:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, rows = [], 0
    if rows:
        yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """Links (a long, b long) to (node, label): each linked node with the smallest node it reaches.  Nulls are ignored.

    Each partition first shrinks its links to a forest, so a large dense group becomes a few links a node.  Then stars
    are joined until nothing changes; a node with very many links is a skewed join key, which adaptive execution splits,
    and minima are taken before the shuffle.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = cut(edges.mapInArrow(_forest, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("label")), F.struct(F.col("v").alias("node"), F.col("v").alias("label")))).alias("e")).select("e.*").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a link up has one only, and none down: then each component is one star around its least node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    ups = ends.select("e.*").groupBy("n").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all"))
    return not ups.agg(F.max((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("all") > 1)))).first()[0]
