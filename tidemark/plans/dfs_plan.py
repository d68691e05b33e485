"""Enumeration of multi-hop aggregation features over the graph of references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from tidemark.sources.schema import RelDatabase, RelTable

NUMERIC = ("SUM", "MEAN", "MIN", "MAX", "STD")
TIMES = ("MEAN", "MIN", "MAX")
CATEGORIES = ("MODE", "NUM_UNIQUE")


@dataclass(frozen=True)
class Feature:
    """A column of a table: a base column, one reached through a reference, or an aggregate of child rows."""

    name: str
    hops: int
    kind: str  # number, time or category


@dataclass
class Node:
    """What to compute at one table of the walk: base columns, parents reached by reference, children to aggregate."""

    table: str
    budget: int
    base: list[Feature]
    parents: list[tuple[str, Node]] = field(default_factory=list)
    children: list[tuple[str, Node]] = field(default_factory=list)

    def features(self) -> list[Feature]:
        """Features of this table's rows, by hops from it."""
        out = list(self.base)
        for column, node in self.parents:
            via = node.table if sum(n.table == node.table for _, n in self.parents) == 1 else f"{node.table}[{column}]"
            out += [Feature(f"{via}.{f.name}", f.hops + 1, f.kind) for f in node.features()]
        for column, node in self.children:
            out.append(Feature(f"COUNT({node.table})" if _sole(self, node) else f"COUNT({node.table}[{column}])", 1, "number"))
            for f in node.features():
                out += [Feature(f"{a}({_child(self, column, node)}.{f.name})", f.hops + 1, _kind(a, f)) for a in aggregates(f)]
        return [f for f in out if f.hops <= self.budget]


def aggregates(f: Feature) -> tuple[str, ...]:
    return {"number": NUMERIC, "time": TIMES, "category": CATEGORIES}[f.kind]


def _kind(aggregate: str, f: Feature) -> str:
    if aggregate == "MODE":
        return "category"
    return "time" if f.kind == "time" and aggregate in TIMES else "number"


def _sole(parent: Node, node: Node) -> bool:
    return sum(n.table == node.table for _, n in parent.children) == 1


def _child(parent: Node, column: str, node: Node) -> str:
    return node.table if _sole(parent, node) else f"{node.table}[{column}]"


def base_features(t: RelTable) -> list[Feature]:
    out = []
    for f in t.df.schema.fields:
        if f.name == t.pkey or f.name in t.fkeys:
            continue
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(Feature(f"{f.name}_epochtime", 0, "time"))
        elif isinstance(f.dataType, T.NumericType):
            out.append(Feature(f.name, 0, "number"))
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out.append(Feature(f.name, 0, "category"))
    return out


def plan(db: RelDatabase, table: str, budget: int, came: tuple[str, str, str] | None = None) -> Node:
    """The walk from a table with ``budget`` hops; the reference just taken is not taken back."""
    t = db[table]
    node = Node(table, budget, base_features(t))
    if budget > 0:
        for column, parent in t.fkeys.items():
            if came != (table, column, parent):
                node.parents.append((column, plan(db, parent, budget - 1, (table, column, parent))))
        if t.pkey:
            for name, child in db.tables.items():
                for column, parent in child.fkeys.items():
                    if parent == table and came != (name, column, table):
                        node.children.append((column, plan(db, name, budget - 1, (name, column, table))))
    return node


def depths(db: RelDatabase, entity: str, max_depth: int) -> dict[str, int]:
    """Column name to depth; the hop from the anchor to the entity counts one."""
    root = plan(db, entity, max_depth - 1)
    return {column_name(entity, f): f.hops + 1 for f in root.features()}


def column_name(entity: str, f: Feature) -> str:
    return f"d{f.hops + 1}__{entity}.{f.name}"
