"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Every vector is scaled to length one and projected on ``projections`` random normal directions.  Two vectors at cosine
``least`` differ in a projection by a normal variable of known spread, so a window of half-width ``window`` around a
query holds the other with a known chance; the least number of windows that must hold a pair is calibrated from the
binomial law to a recall of ``recall``.  Pairs that reach it are verified in double precision.

Vectors are sorted by their first projection and cut into blocks of ``block_rows``.  The blocks whose ranges lie within
``reach`` spreads of a block's (beyond it a linked pair has a chance under 1e-6) are an interval of block numbers, found
by running extremes over the sorted ranges.  A tile is two blocks of such an interval.  In a tile windows are counted
query strip by query strip in bounded memory; a tile returns link counts and a spanning forest of its links, never all
pairs.  Equal vectors are one row with a weight, whatever their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, range_numbered
from tidemark.llm.components import components

#: Queries counted at a time, projections counted for all pairs before the few that can still pass go on alone.
_STRIP, _DENSE = 64, 20


def calibrate(least: float, window: float, projections: int, recall: float) -> int:
    """The largest count that a pair at cosine ``least`` reaches with a chance of ``recall`` or more."""
    spread = sqrt(2 - 2 * least)
    p = erf(window * spread / spread / sqrt(2))
    reached = 0.0
    for count in range(projections, -1, -1):
        reached += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if reached >= recall:
            return count
    return 0


def directions(dim: int, projections: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def _prepare(projections: int):
    """(id, vector) batches to (id, valid, dim, digest, unit vector, first projection)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for item in batch.column(1):
                raw = item.values
                x = None
                if raw is not None and len(raw) and not raw.null_count:
                    x = raw.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    x = x / top if np.isfinite(top) and top > 0 else None
                if x is None:
                    for column, value in zip(out, (0, None, None, None, None), strict=True):
                        column.append(value)
                    continue
                unit = x / np.sqrt(x @ x)
                if len(unit) not in known:
                    known[len(unit)] = directions(len(unit), projections)[:, 0]
                digest = hashlib.blake2b(raw.to_numpy(zero_copy_only=False).astype(np.float64).tobytes(), digest_size=16).digest()
                values = (len(unit), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), unit.tobytes(), float(unit @ known[len(unit)]))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64()), strict=True)]],
                names=["id", "dim", "d1", "d2", "unit", "at"],
            )

    return run


def _tile(least: float, window: float, projections: int, need: int):
    """One tile to rows (a, null, weight linked to a) and forest rows (a, b, null)."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        block, node, weight = (rows[c].to_numpy() for c in ("block", "node", "weight"))
        unit = np.frombuffer(b"".join(rows["unit"].to_pylist()), np.float64).reshape(len(node), -1)
        shadow = unit @ directions(unit.shape[1], projections)
        half = window * sqrt(2 - 2 * least)
        # Projections as steps of a window's half over 64, so a window is an integer interval; one step is added for rounding.
        steps = np.clip(np.rint(shadow / half * 64), -16000, 16000).astype(np.int16)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        left, right = left[np.argsort(shadow[left, 0])], right[np.argsort(shadow[right, 0])]
        count = np.zeros(len(node), np.int64)
        a, b = [], []
        across = np.ascontiguousarray(steps[right].T)
        dense = min(_DENSE, projections)
        gap, inside, hits = (np.empty((_STRIP, len(right)), t) for t in (np.int16, np.bool_, np.uint8))
        for first in range(0, len(left), _STRIP):
            query = left[first : first + _STRIP]
            n = len(query)
            hits[:n] = 0
            for k in range(dense):
                np.subtract(steps[query, k][:, None] + np.int16(65), across[k][None, :], out=gap[:n])
                np.less_equal(gap[:n].view(np.uint16), 130, out=inside[:n])
                np.add(hits[:n], inside[:n].view(np.uint8), out=hits[:n])
            x, y = np.nonzero(hits[:n] >= need - (projections - dense))
            had = hits[x, y]
            for k in range(dense, projections):
                had = had + (np.abs(steps[query[x], k] - across[k][y]) <= 65)
                still = had >= need - (projections - 1 - k)
                x, y, had = x[still], y[still], had[still]
            x, y = query[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for s in range(0, len(x), 1 << 15):
                u, v = x[s : s + (1 << 15)], y[s : s + (1 << 15)]
                linked = np.einsum("ij,ij->i", unit[u], unit[v]) >= least
                u, v = u[linked], v[linked]
                np.add.at(count, u, weight[v])
                np.add.at(count, v, weight[u])
                a.append(u)
                b.append(v)
        ends = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        root = np.arange(len(node))
        while True:
            low = np.minimum(root[ends[0]], root[ends[1]])
            new = root.copy()
            np.minimum.at(new, root[ends[0]], low)
            np.minimum.at(new, root[ends[1]], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        moved, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(count)
        return pa.table(
            {
                "a": np.concatenate((node[some], node[moved])),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[root[moved]])]),
                "w": pa.concat_arrays([pa.array(count[some]), pa.nulls(len(moved), pa.int64())]),
            }
        )

    return run


def near_vectors(
    vectors: DataFrame,
    least: float = 0.95,
    projections: int = 24,
    window: float = 2.5,
    recall: float = 0.99999,
    reach: float = 5.0,
    block_rows: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``window`` counts spreads of a pair at cosine ``least``.  Vectors of different lengths are never compared.

    Equal vectors are one class whatever their ids, and rows that share an id with other vectors are each linked by their own.

    Nulls: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; a row with a
    null id cannot be named and is alone, kept, with no links.  Repeated rows are vectors of their own: each links with
    the others.  An empty table gives no rows; other columns are ignored.
    """
    need = calibrate(least, window, projections, recall)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = "id long, dim int, d1 long, d2 long, unit binary, at double"
    prepared = cut(rows.mapInArrow(_prepare(projections), schema))
    usable = F.coalesce(F.col("dim") > 0, F.lit(False)) & F.col("id").isNotNull()
    classes = prepared.where(usable).groupBy("dim", "d1", "d2").agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"), F.first("at").alias("at")
    )
    placed = range_numbered(classes, ["at", "d1", "d2"], by=["dim"]).withColumn("block", F.expr(f"index div {block_rows}"))
    # A class is named by its place, not by an id, which other vectors may have too.
    placed = cut(placed.select("dim", F.monotonically_increasing_id().alias("node"), "low", "weight", "unit", "at", "block", "d1", "d2"))
    ranges = cut(placed.groupBy("dim", "block").agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
    near = _intervals(ranges, reach * sqrt(2 - 2 * least))
    tiles = (
        placed.join(near, ["dim", "block"])
        .withColumn("other", F.explode(F.sequence("first", "last")))
        .select("dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "weight", "unit")
    )
    found = cut(
        tiles.groupBy("dim", "i", "j").applyInArrow(_tile(least, window, projections, need), "a long, b long, w long")
    )
    joined = cut(components(found.where("b IS NOT NULL").select("a", "b")))
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w"))
    labelled = placed.select("dim", "d1", "d2", "node", "low", "weight").join(sums, "node", "left").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    labelled = labelled.join(lowest, "label").select("dim", "d1", "d2", (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = prepared.where(usable).select("id", "dim", "d1", "d2").join(labelled, ["dim", "d1", "d2"]).select("id", "n_links", "component_id")
    out = out.unionByName(
        prepared.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    )
    return out.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _intervals(ranges: DataFrame, gap: float) -> DataFrame:
    """Sorted ranges (dim, block, lo, hi) to the interval of blocks (first, last) within ``gap`` of each, by two running extremes."""
    mark = F.lit(None).cast("long")
    ahead = ranges.select("dim", F.col("lo").alias("v"), F.col("block").alias("seen"), mark.alias("block")).unionByName(
        ranges.select("dim", (F.col("hi") + gap).alias("v"), mark.alias("seen"), "block")
    )
    behind = ranges.select("dim", (-F.col("hi")).alias("v"), F.col("block").alias("seen"), mark.alias("block")).unionByName(
        ranges.select("dim", (gap - F.col("lo")).alias("v"), mark.alias("seen"), "block")
    )
    run = Window.partitionBy("dim").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = ahead.withColumn("last", F.max("seen").over(run)).where("block IS NOT NULL").select("dim", "block", "last")
    first = behind.withColumn("first", F.min("seen").over(run)).where("block IS NOT NULL").select("dim", "block", "first")
    return last.join(first, ["dim", "block"])
