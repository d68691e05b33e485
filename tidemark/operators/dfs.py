"""Multi-hop aggregation features with a strict cutoff per anchor row.

Every timed row that an aggregate reaches must be earlier than its anchor; nested levels keep the anchor's cutoff.  Two
ways to the same numbers:

* ``features``: child rows are joined to distinct (key, cutoff) pairs, aggregated, and nested levels recurse with the
  child's keys.  Anchors that share key and cutoff are computed once.  It takes every primitive and depth.  Where the
  cutoffs are a grid of few times, mergeable primitives of children without keys of their own are counted per interval
  of the grid and accumulated along it, so their rows are not copied per anchor and a hot key is combined before the shuffle.
* ``running_features``: for direct children and mergeable primitives, children and anchors are stacked and a window
  accumulates states up to each anchor.  One shuffle, and no child row is copied per anchor, which is what large
  histories need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import calendar, epoch_ns, quoted, temporal_diff, typed_columns
from tidemark.operators.numbering import cut
from tidemark.plans.dfs_plan import Node, aggregates, column_name, depths, plan
from tidemark.sources.schema import RelDatabase, RelTable

HISTORY = "_target_history"
#: Distinct cutoffs up to which intervals are found by a search tree inside each row; this decides on plans, never on results.
GRID = 128
MERGEABLE = ("SUM", "MEAN", "MIN", "MAX", "STD")


def _base(t: RelTable) -> list[Column]:
    """Base columns as doubles, epoch nanoseconds and strings."""
    out = []
    for f in t.df.schema.fields:
        if f.name == t.pkey or f.name in t.fkeys:
            continue
        kind = f.dataType.typeName()
        c = F.col(quoted(f.name))
        if kind.startswith(("timestamp", "date")):
            out.append(epoch_ns(c).alias(f"{f.name}_epochtime"))
        elif kind in ("string", "boolean"):
            out.append(c.cast("string").alias(f.name))
        elif kind not in ("array", "map", "struct", "binary"):
            out.append(c.cast("double").alias(f.name))
    return out


def _aggregate(name: str, c: Column) -> Column:
    return {
        "SUM": F.sum, "MEAN": F.avg, "MIN": F.min, "MAX": F.max, "STD": F.stddev_samp,
        "MODE": lambda x: F.mode(x, True), "NUM_UNIQUE": lambda x: F.count_distinct(x).cast("double"),
    }[name](c)


def _grid(keys: DataFrame) -> list[Column] | None:
    """The distinct cutoffs in their order, or None where there are more than a tree may hold.  Strings keep the session's zone."""
    kind = keys.schema["_at"].dataType
    found = keys.select(F.col("_at").cast("string").alias("_s"), "_at").where("_at IS NOT NULL").distinct().orderBy("_at").limit(GRID + 1).collect()
    return [F.lit(r["_s"]).cast(kind) for r in found] if 0 < len(found) <= GRID else None


def _first_after(t: Column, grid: list[Column]) -> Column:
    """The first time of the grid after ``t``; null if there is none."""
    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return grid[low]
        middle = (low + high) // 2
        return F.when(t < grid[middle - 1], search(low, middle)).otherwise(search(middle, high))

    return F.when(t < grid[-1], search(0, len(grid)))


def _accumulated(rows: DataFrame, keys: DataFrame, grid: list[Column], count: str | None, made: list[tuple[str, str, str]]) -> DataFrame:
    """(_k2, _a2) and aggregates (primitive, column, name) of the rows (_ref, _t) before each cutoff, from states per interval.

    Squares are taken around an interval's own mean, and means of intervals around the key's first one, so large values do
    not cancel.
    """
    columns = list(dict.fromkeys(c for _, c, _ in made))
    spread = [i for i, c in enumerate(columns) if any(a == "STD" and x == c for a, x, _ in made)]
    placed = rows.where("_ref IS NOT NULL").withColumn("_at", _first_after(F.col("_t"), grid)).where("_at IS NOT NULL")
    parts = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        v = F.col(quoted(c))
        parts += [F.count(v).alias(f"_c{i}"), F.sum(v).alias(f"_s{i}"), F.min(v).alias(f"_l{i}"), F.max(v).alias(f"_h{i}")]
        if i in spread:
            parts += [F.avg(v).alias(f"_m{i}"), (F.var_pop(v) * F.count(v)).alias(f"_q{i}")]
    states = placed.groupBy(F.col("_ref").alias("_key"), "_at").agg(*parts).withColumn("_side", F.lit(0))
    both = states.unionByName(keys.select("_key", "_at").withColumn("_side", F.lit(1)), allowMissingColumns=True)
    so_far = W.partitionBy("_key").orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.select("*", *[(F.col(f"_m{i}") - F.first(f"_m{i}", True).over(so_far)).alias(f"_d{i}") for i in spread])
    total = lambda name: F.sum(name).over(so_far)
    out = [F.coalesce(total("_n"), F.lit(0)).cast("double").alias(count)] if count else []
    for a, c, name in made:
        i = columns.index(c)
        n = total(f"_c{i}")
        if a == "STD":
            off, far = F.col(f"_c{i}") * F.col(f"_d{i}"), F.col(f"_c{i}") * F.col(f"_d{i}") * F.col(f"_d{i}")
            between = F.greatest(total(far) - total(off) * total(off) / n, F.lit(0.0))
            value = F.when(n > 1, F.sqrt((total(f"_q{i}") + between) / (n - 1)))
        else:
            value = {"SUM": total(f"_s{i}"), "MEAN": F.when(n > 0, total(f"_s{i}") / n), "MIN": F.min(f"_l{i}").over(so_far), "MAX": F.max(f"_h{i}").over(so_far)}[a]
        out.append(value.alias(name))
    return both.select(F.col("_key").alias("_k2"), F.col("_at").alias("_a2"), "_side", *out).where("_side = 1").drop("_side")


def _own(db: RelDatabase, node: Node, rows: DataFrame, grid: list[Column] | None) -> DataFrame:
    """(``_key``, ``_at``) rows of distinct keys and cutoffs of a table to its features, under their names."""
    t = db[node.table]
    timed = t.time_col is not None
    parents = [c for c, _ in node.parents]
    attributes = t.df.select(
        F.col(quoted(t.pkey)).alias("_pk"), *_base(t), *[F.col(quoted(c)).alias(f"_fk_{c}") for c in parents],
        *([F.col(quoted(t.time_col)).alias("_t")] if timed else []),
    )
    match = F.col("_key") == F.col("_pk")
    if timed:
        match = match & (F.col("_t") < F.col("_at"))
    out = rows.join(attributes, match, "left").drop("_pk", "_t")
    return _reach(db, node, out, grid)


def _reach(db: RelDatabase, node: Node, out: DataFrame, grid: list[Column] | None) -> DataFrame:
    """Add parents' and children's features to rows with ``_key``, ``_at`` and the ``_fk_`` columns."""
    wanted = {f.name for f in node.features()}
    base = out  # keys are taken from here, not from what is joined on
    asked = base.select("_key", "_at").distinct()
    if len(node.children) > 1:
        asked = cut(asked)
    for column, parent in node.parents:
        via = parent.table if sum(n.table == parent.table for _, n in node.parents) == 1 else f"{parent.table}[{column}]"
        keys = base.select(F.col(quoted(f"_fk_{column}")).alias("_key"), "_at").where("_key IS NOT NULL").distinct()
        found = _own(db, parent, keys, grid)
        names = [f.name for f in parent.features() if f"{via}.{f.name}" in wanted]
        found = found.select(F.col("_key").alias("_k2"), F.col("_at").alias("_a2"), *[F.col(quoted(n)).alias(f"{via}.{n}") for n in names])
        out = out.join(found, (F.col(quoted(f"_fk_{column}")) == F.col("_k2")) & (F.col("_at") == F.col("_a2")), "left").drop("_k2", "_a2")
    out = out.drop(*[f"_fk_{c}" for c, _ in node.parents])
    for column, child in node.children:
        label = child.table if sum(n.table == child.table for _, n in node.children) == 1 else f"{child.table}[{column}]"
        found = _children(db, column, child, asked, label, wanted, grid)
        out = out.join(found, (F.col("_key") == F.col("_k2")) & (F.col("_at") == F.col("_a2")), "left").drop("_k2", "_a2")
        count = f"COUNT({label})"
        if count in wanted:
            out = out.withColumn(count, F.coalesce(F.col(quoted(count)), F.lit(0.0)))
    return out


def _children(db: RelDatabase, column: str, child: Node, keys: DataFrame, label: str, wanted: set[str], grid: list[Column] | None) -> DataFrame:
    t = db[child.table]
    fks = [c for c, _ in child.parents]
    nested = bool(child.children)
    rows = t.df.select(
        F.col(quoted(column)).alias("_ref"), *_base(t), *[F.col(quoted(c)).alias(f"_fk_{c}") for c in fks],
        *([F.col(quoted(t.pkey)).alias("_ck")] if nested else []),
        *([F.col(quoted(t.time_col)).alias("_t")] if t.time_col else []),
    )
    whole = [(a, f.name, f"{a}({label}.{f.name})") for f in child.features() for a in aggregates(f) if f"{a}({label}.{f.name})" in wanted]
    count = f"COUNT({label})" if f"COUNT({label})" in wanted else None
    summed = None
    if grid and t.time_col and not nested and not fks:
        along = [x for x in whole if x[0] in MERGEABLE and dict(rows.dtypes).get(x[1]) in ("double", "bigint")]
        if along or count:
            summed = _accumulated(rows, keys, grid, count, along)
            whole, count = [x for x in whole if x not in along], None
            if not whole:
                return summed
    match = F.col("_key") == F.col("_ref")
    if t.time_col:
        match = match & (F.col("_t") < F.col("_at"))
    joined = keys.join(rows, match).drop("_ref", "_t").withColumnRenamed("_key", "_owner")
    joined = joined.withColumnRenamed("_ck", "_key") if nested else joined.withColumn("_key", F.lit(None).cast("long"))
    reached = _reach(db, child, joined, grid) if nested or fks else joined
    made = [F.count(F.lit(1)).cast("double").alias(count)] if count else []
    made += [_aggregate(a, F.col(quoted(c))).alias(name) for a, c, name in whole]
    made = made or [F.count(F.lit(1)).alias("_n")]
    out = reached.groupBy(F.col("_owner").alias("_k2"), F.col("_at").alias("_a2")).agg(*made).drop("_n")
    return out if summed is None else summed.join(out, ["_k2", "_a2"], "left")


def with_history(db: RelDatabase, history: DataFrame, entity: str, entity_col: str, time_col: str) -> RelDatabase:
    """The label table as a child of the entity: strictly earlier labels become features."""
    return RelDatabase({**db.tables, HISTORY: RelTable(history, None, {entity_col: entity}, time_col)})


def features(
    anchors: DataFrame, db: RelDatabase, entity: str, entity_col: str, time_col: str, max_depth: int = 2,
    history: DataFrame | None = None, target_col: str | None = None,
) -> DataFrame:
    """Anchor columns (without target) and one column ``d<depth>__<entity>.<feature>`` per feature up to the depth."""
    if target_col and target_col in anchors.columns:
        anchors = anchors.drop(target_col)
    if history is not None and time_col in history.columns:
        db = with_history(db, history, entity, entity_col, time_col)
    root = plan(db, entity, max_depth - 1)
    # Anchors come from a label query: every branch of the walk reads the cut, not the query.
    anchors = cut(anchors)
    keys = cut(anchors.select(F.col(quoted(entity_col)).alias("_key"), F.col(quoted(time_col)).alias("_at")).distinct())
    found = _own(db, root, keys, _grid(keys))
    named = found.select(
        F.col("_key").alias("_k"), F.col("_at").alias("_a"), *[F.col(quoted(f.name)).alias(column_name(entity, f)) for f in root.features()]
    )
    joined = anchors.join(named, (F.col(quoted(entity_col)) == F.col("_k")) & (F.col(quoted(time_col)) == F.col("_a")), "left")
    return joined.drop("_k", "_a")


def at_depth(matrix: DataFrame, of: dict[str, int], depth: int) -> DataFrame:
    """Columns up to a depth; columns that are no features stay.  A plain projection of the deeper matrix."""
    if not any(c in of for c in matrix.columns):
        raise ValueError("the matrix has no known feature")
    return matrix.select(*[F.col(quoted(c)) for c in matrix.columns if of.get(c, -1) <= depth])


def finished(matrix: DataFrame, entity_col: str, time_col: str, add_calendar: bool = False) -> tuple[DataFrame, list[str]]:
    """Times since events, optional calendar, typed columns; ids go."""
    out = temporal_diff(matrix, time_col)
    if add_calendar:
        out = out.select("*", *calendar(F.col(quoted(time_col)), "anchor_"))
    return typed_columns(out, (entity_col,))


def running_features(
    anchors: DataFrame, child: RelTable, fkey: str, columns: Sequence[str], entity_col: str, time_col: str, prefix: str
) -> DataFrame:
    """COUNT, SUM, MEAN, MIN, MAX, STD of a direct child strictly before each anchor, by one accumulating window.

    Squares are taken around the key's first value, so large values do not cancel.
    """
    keys = anchors.select(F.col(quoted(entity_col)).alias("_key"), F.col(quoted(time_col)).alias("_t")).distinct()
    rows = child.df.select(
        F.col(quoted(fkey)).alias("_key"), F.col(quoted(child.time_col)).alias("_t"), F.lit(1).alias("_side"),
        *[F.col(quoted(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns)],
    )
    both = rows.unionByName(keys.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy("_key").orderBy("_t", "_side")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    seen = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.select("*", *[(F.col(f"v{i}") - F.first(f"v{i}", True).over(seen)).alias(f"o{i}") for i in range(len(columns))])
    made = [F.coalesce(F.sum("_side").over(before), F.lit(0)).cast("double").alias(f"{prefix}.COUNT")]
    for i, c in enumerate(columns):
        v, off = F.col(f"v{i}"), F.col(f"o{i}")
        n, s, q = F.count(v).over(before), F.sum(off).over(before), F.sum(off * off).over(before)
        made += [
            F.sum(v).over(before).alias(f"{prefix}.SUM({c})"), F.avg(v).over(before).alias(f"{prefix}.MEAN({c})"),
            F.min(v).over(before).alias(f"{prefix}.MIN({c})"), F.max(v).over(before).alias(f"{prefix}.MAX({c})"),
            F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))).alias(f"{prefix}.STD({c})"),
        ]
    found = both.select("_key", "_t", "_side", *made).where("_side = 0").drop("_side")
    match = (F.col(quoted(entity_col)) == F.col("_key")) & (F.col(quoted(time_col)) == F.col("_t"))
    return anchors.join(found, match, "left").drop("_key", "_t")


__all__ = ["at_depth", "depths", "features", "finished", "running_features", "with_history"]
