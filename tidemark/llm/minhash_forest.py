"""MinHash near-duplicates by an LSH forest.

Every document's set of word shingles gets ``trees`` keys of ``depth`` minhash values.  Each tree is a sorted order of
its keys: documents next to each other share the longest prefix there.  A region is a run that shares the first
``least_depth`` values.  In a region of up to ``reach + 1`` documents all pairs are candidates, whatever the depth; in a
larger one depth adapts, and a document's candidates are its next neighbours in the order, which share the longest
prefixes.  Candidates are confirmed on full sets.  Large regions that these links do not bring into one component are
then compared in tiles of two blocks, exactly and between different components only: what is outside a region's largest
component with all of the region.  So no pair that shares a region is lost; a tile returns one link for each pair of
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, settle, small_batches
from tidemark.llm.components import components
from tidemark.llm.text import chunks, mix, shingle_sets

#: Documents, and shingle hashes of all of them, in a block of a large region; a tile holds two blocks.
TILE, TILE_ITEMS = 1024, 1 << 19

#: Border rows of partitions that one task may sort.
BORDER_ROWS = 1 << 16

#: Shingles whose incidence is held at once in a tile.
TILE_COLUMNS = 512

_SEED = 0x5851F42D4C957F2D


def _signer(width: int, trees: int, depth: int):
    """(id, text) batches to (id, size, digest of the set in two longs, big-endian minhash values)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = trees * depth
        random = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_SEED))
        times = (random[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        plus = (random[n:] >> np.uint64(32)).astype(np.uint32)
        for batch in batches:
            for first, last, buf, bounds in chunks(batch.column(1)):
                sets, at = shingle_sets(buf, bounds, width)
                size = np.diff(at)
                full = size > 0
                begin = at[:-1][full]
                digests = np.zeros((2, last - first), np.int64)
                keys = np.zeros((n, int(full.sum())), ">u4")
                if len(begin):
                    for k in range(2):
                        spread = mix(sets + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (2**64 - 1)))
                        digests[k, full] = np.add.reduceat(spread, begin).view(np.int64)
                    short = (sets >> np.uint64(32)).astype(np.uint32)
                    for k in range(n):
                        keys[k] = np.minimum.reduceat(short * times[k] + plus[k], begin)
                raw = np.ascontiguousarray(keys.T).tobytes()
                step, which = 4 * n, np.cumsum(full) - 1
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(size),
                        pa.array(digests[0]),
                        pa.array(digests[1]),
                        pa.array(
                            [raw[step * i : step * i + step] if f else None for i, f in zip(which, full, strict=True)],
                            pa.binary(),
                        ),
                    ],
                    names=["id", "size", "d1", "d2", "keys"],
                )

    return sign


def _sets(width: int):
    """(id, text) batches to (id, distinct shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, bounds in chunks(batch.column(1)):
                sets, at = shingle_sets(buf, bounds, width)
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(first, last - first), values], names=["id", "items"])

    return run


def _neighbours(reach: int, percent: int):
    """Sorted (tree, key, size, node, region, large) batches to pairs (a, b) of neighbours in one region.

    In a small region every later document within ``reach`` is a neighbour, in a large one the next document only.  The
    first and last ``reach`` rows of a partition go out as edge rows too (b null), for pairs over a border of partitions.
    """
    names = ("tree", "key", "size", "region", "large")
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *zip(names, kinds, strict=True)])

    def edge(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        return pa.record_batch(
            [rows["node"].chunk(0), pa.nulls(rows.num_rows, pa.int64()), *[rows[n].chunk(0) for n in names]], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if tail is None:
                yield edge(rows.slice(0, reach))
            joined = rows if tail is None else pa.concat_tables([tail, rows])
            a, b = pairs(joined, 0 if tail is None else tail.num_rows)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b), *[pa.nulls(len(a), k) for k in kinds]], schema=schema)
            tail = joined.slice(max(0, joined.num_rows - reach)).combine_chunks()
        if tail is not None:
            yield edge(tail)

    def pairs(rows: pa.Table, old: int) -> tuple[np.ndarray, np.ndarray]:
        node, size, region = (rows[c].to_numpy() for c in ("node", "size", "region"))
        large = rows["large"].to_numpy()
        a, b = [], []
        for lag in range(1, min(reach, len(node) - 1) + 1):
            i = np.arange(max(0, old - lag), len(node) - lag)
            j = i + lag
            small, most = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = (region[i] == region[j]) & (100 * small >= percent * most) & (node[i] != node[j])
            if lag > 1:
                ok &= ~large[i]
            a.append(np.minimum(node[i[ok]], node[j[ok]]))
            b.append(np.maximum(node[i[ok]], node[j[ok]]))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    return run


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    trees: int = 16,
    depth: int = 8,
    least_depth: int = 4,
    reach: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; ``component_id`` is the
    smallest id that a document reaches by links, and the document with that id is kept.

    Nulls: a null or empty text has no shingles and is linked with nothing; a row with a null id cannot be named by a
    link and stays alone, with a null component, kept.  Repeated rows share a component, and each is kept if its id is
    the component's.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(
        texts.mapInArrow(_signer(width, trees, depth), "id long, size long, d1 long, d2 long, keys binary")
    )
    classes = cut(
        signed.where("id IS NOT NULL AND size > 0")
        .groupBy("d1", "d2", "size")
        .agg(F.min("id").alias("node"), F.first("keys").alias("keys"))
    )
    step = 4 * depth
    rows = classes.select(
        F.posexplode(F.array(*[F.substring("keys", 1 + t * step, step) for t in range(trees)])).alias("tree", "key"),
        "size",
        "node",
    ).withColumn("region", F.xxhash64("tree", F.substring("key", 1, 4 * least_depth)))
    large = settle(
        rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items")).where(F.col("n") > reach + 1)
    ).side
    flags = large.select("region", F.lit(True).alias("large"))
    flagged = rows.join(flags, "region", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    order = ["tree", "key", "node"]
    sorted_rows = flagged.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "key", "size", "node", "region", "large")
    make = _neighbours(reach, percent)
    schema = "a long, b long, tree int, key binary, size long, region long, large boolean"
    found = cut(sorted_rows.mapInArrow(make, schema))
    pairs = found.where("b IS NOT NULL").select("a", "b")
    # Rows at the borders of partitions, at most 2 * reach of each, are sorted runs of their own, until one task holds them.
    edges, parts = found, found.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-2 * reach * parts // BORDER_ROWS)
        border = edges.where("b IS NULL").select("tree", "key", "size", F.col("a").alias("node"), "region", "large").distinct()
        border = border.coalesce(1) if parts == 1 else border.repartitionByRange(parts, *order)
        edges = cut(border.sortWithinPartitions(*order).mapInArrow(make, schema))
        pairs = pairs.unionByName(edges.where("b IS NOT NULL").select("a", "b"))
    candidates = cut(pairs.distinct())
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = cut(_confirm(candidates, _sets_of(texts, nodes, width), percent))
    joined = cut(components(links))
    # Large regions: what their neighbours have not brought into one component is compared in tiles.
    inside = rows.select("region", "node", "size").join(large, "region", "left_semi").join(joined, "node", "left")
    inside = inside.withColumn("label", F.coalesce("label", "node"))

    def blocks(n: Column, items: Column) -> Column:
        return F.greatest(F.ceil(n / TILE), F.ceil(items / TILE_ITEMS))

    by_label = inside.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items"))
    mixed = settle(
        by_label.groupBy("region")
        .agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label", "items")).alias("main"), F.sum("n").alias("n"), F.sum("items").alias("items"))
        .where("labels > 1")
        .select(
            "region", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.items")).alias("blocks"),
            blocks(F.col("n") - F.col("main.n"), F.col("items") - F.col("main.items")).alias("others"),
        )
    )
    if mixed.rows:
        inside = cut(inside.drop("size").join(mixed.side, "region"))
        sets = _sets_of(texts, inside.select(F.col("node").alias("id")).distinct(), width)
        # The largest component needs no pairs of its own: its blocks come after the others' and only meet those.
        in_main = F.col("label") == F.col("main")
        tiles = (
            inside.join(sets, F.col("node") == F.col("id"))
            .withColumn("block", F.when(in_main, F.expr("others + pmod(xxhash64(node), blocks)")).otherwise(F.expr("pmod(xxhash64(node), others)")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("blocks")) - 1)))
            .select("region", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "node", "items")
        )
        more = tiles.groupBy("region", "i", "j").applyInArrow(_tile(percent), "a long, b long")
        joined = cut(components(links.unionByName(more)))
    labelled = classes.join(joined, "node", "left").select(
        "d1", "d2", "size", F.coalesce("label", "node").alias("component_id")
    )
    out = _spread(signed, labelled)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _sets_of(texts: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The shingle sets of the documents with these ids."""
    chosen = texts.where("id IS NOT NULL").join(nodes, "id", "left_semi")
    return cut(chosen.mapInArrow(_sets(width), "id long, items array<long>"))


def _tile(percent: int):
    """One tile (two blocks) of a large region: links between different components, one for each pair of components.

    Intersections are counted exactly, as products of the incidence of those shingles that two texts have.
    """

    def run(rows: pa.Table) -> pa.Table:
        items = rows["items"].combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        values, at = items.flatten().to_numpy(), items.offsets.to_numpy()
        at = at - at[0]
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        block, label, node = (rows[c].to_numpy() for c in ("block", "label", "node"))
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, TILE_COLUMNS):
            a, b = np.searchsorted(column, (first, first + TILE_COLUMNS))
            dense = np.zeros((len(block), TILE_COLUMNS), np.float32)
            dense[owner[a:b], column[a:b] - first] = 1
            common += dense[left] @ dense[right].T
        size = np.diff(at).astype(np.float32)
        linked = 100 * common >= percent * (size[left][:, None] + size[right] - common)
        linked &= label[left][:, None] != label[right]
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        pairs = np.stack((np.minimum(label[x], label[y]), np.maximum(label[x], label[y])), 1)
        _, one = np.unique(pairs, axis=0, return_index=True)
        return pa.table({"a": node[x[one]], "b": node[y[one]]})

    return run


def _spread(signed: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every document with its class's component; those without shingles or id stay alone."""
    alone = F.col("id").isNull() | (F.col("size") == 0)
    linked = signed.where(~alone).select("id", "size", "d1", "d2").join(labelled, ["d1", "d2", "size"])
    return linked.select("id", "size", "component_id").unionByName(
        signed.where(alone).select("id", "size", F.col("id").alias("component_id"))
    )


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets overlap enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
