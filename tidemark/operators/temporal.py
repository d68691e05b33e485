"""Anchors, censoring, splits and prediction seeds.  Censoring keeps ``time <= cutoff``; labels look at (t, t + step]."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.sources.schema import RelDatabase, warn


def anchor_frame(spark: SparkSession, anchors: Sequence[datetime]) -> DataFrame:
    """One ``timestamp`` column; a handful of rows, so joins broadcast it.

    The rows stand in the plan as values, so Spark knows how few they are.  Of rows made in Python it knows no size, and an
    outer join on a range of times then broadcasts the other side, which is the data.
    """
    if not anchors:
        return spark.createDataFrame([], "timestamp timestamp_ntz")
    rows = ", ".join(f"(TIMESTAMP_NTZ '{a.replace(tzinfo=None)}')" for a in anchors)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS anchors(timestamp)")


def train_anchors(val: datetime, step: timedelta, earliest: datetime, least: int = 3) -> list[datetime]:
    """Backwards from ``val`` in steps, down to the earliest time in the data."""
    out, at = [], val - step
    while at >= earliest:
        out.append(at)
        at -= step
    if len(out) < least:
        raise ValueError(f"{len(out)} training anchors; {least} are needed")
    return out[::-1]


def eval_anchors(start: datetime, step: timedelta, n: int, before: datetime | None = None) -> list[datetime]:
    found = [start + k * step for k in range(n)]
    return [a for a in found if before is None or a < before]


def scrub(db: RelDatabase) -> RelDatabase:
    """References to rows that are not there become null.

    Every reference column is joined once to the surviving keys of its parent; parents are immutable, so the database
    the tables came from is not touched.
    """
    out = {}
    for name, t in db.tables.items():
        df = t.df
        for column, parent in t.fkeys.items():
            p = db[parent]
            known = p.df.select(F.col(quoted(p.pkey)).alias("_k")).distinct()
            names = df.columns
            df = df.join(known, F.col(quoted(column)) == F.col("_k"), "left")
            df = df.select(*[F.when(F.col("_k").isNotNull(), F.col(quoted(c))).alias(c) if c == column else F.col(quoted(c)) for c in names])
        out[name] = t.with_df(df)
    return RelDatabase(out)


def drop_dangling(labels: DataFrame, entity_col: str, entities: DataFrame, pkey: str) -> DataFrame:
    """Label rows whose entity is still there."""
    known = entities.select(F.col(quoted(pkey)).alias("_k"))
    return labels.join(known, F.col(quoted(entity_col)) == F.col("_k"), "left_semi")


def canonical_labels(labels: DataFrame, time_col: str, entity_col: str, target_col: str, allowed_extra: Sequence[str] = ()) -> DataFrame:
    wanted = [time_col, entity_col, target_col]
    if extra := [c for c in labels.columns if c not in wanted and c not in allowed_extra]:
        raise ValueError(f"unexpected label columns {extra}")
    return labels.select(*[quoted(c) for c in wanted])


@dataclass(frozen=True)
class Split:
    """A database frozen at a cutoff with its training and evaluation labels; a masked split has no target."""

    db: RelDatabase
    cutoff: datetime
    train: DataFrame
    eval: DataFrame
    target: DataFrame | None = None
    val: DataFrame | None = None


def freeze(db: RelDatabase, cutoff: datetime) -> RelDatabase:
    return scrub(db.upto(cutoff))


def inner_split(db: RelDatabase, entity: str, entity_col: str, train: DataFrame, val: DataFrame, cutoff: datetime, target_col: str) -> Split:
    """Fit on train, score on val, with the database as of the validation cutoff; late entities' seeds are dropped."""
    frozen = freeze(db, cutoff)
    e = frozen[entity]
    train = drop_dangling(train, entity_col, e.df, e.pkey)
    val = drop_dangling(val, entity_col, e.df, e.pkey)
    return Split(frozen, cutoff, train, val.drop(target_col), val)


def outer_split(db: RelDatabase, entity: str, entity_col: str, train: DataFrame, val: DataFrame, test: DataFrame, cutoff: datetime, target_col: str) -> Split:
    frozen = freeze(db, cutoff)
    e = frozen[entity]
    keep = [drop_dangling(x, entity_col, e.df, e.pkey) for x in (train, val, test)]
    return Split(frozen, cutoff, keep[0], keep[2].drop(target_col), None, keep[1])


def concat_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def prediction_seeds(
    db: RelDatabase, entity: str, entity_col: str, time_col: str, at: datetime, ids: DataFrame | Sequence[Any] | str = "all"
) -> DataFrame:
    """(entity, time) rows to predict: all entities that exist at the anchor, or those asked for that do."""
    t = db[entity]
    rows = t.df
    anchor = F.lit(at).cast("timestamp_ntz")
    if t.time_col:
        rows = rows.where(F.col(quoted(t.time_col)) <= anchor)
    rows = rows.select(F.col(quoted(t.pkey)).alias(entity_col))
    if isinstance(ids, str):
        if ids != "all":
            raise TypeError("ids are a list, a frame or 'all'")
    elif isinstance(ids, DataFrame):
        rows = rows.join(ids.toDF(entity_col), entity_col, "left_semi")
    else:
        if not isinstance(ids, (list, tuple, set)):
            raise TypeError("a list of ids is expected; wrap a single id in a list")
        found = rows.where(F.col(quoted(entity_col)).isin(list(ids)))
        if (n := found.count()) < len(set(ids)):
            warn(f"{len(set(ids)) - n} ids are not there at {at}")
        rows = found
    return rows.withColumn(time_col, anchor)


def check_coverage(db: RelDatabase, test: datetime, step: timedelta, n_eval: int, end: datetime | None = None) -> None:
    """Test labels need data up to the last window's end."""
    needed = test + step * n_eval
    end = end or db.time_bounds()[1]
    if end is None or end < needed:
        raise ValueError(f"data end at {end}; labels need {needed}")


def windows_of(events: DataFrame, time_col: str, anchors: Sequence[datetime], step: timedelta) -> DataFrame:
    """Each event with the anchors whose window (t, t + step] holds it.

    The windows are a constant array filtered inside the row, so no join and no shuffle is planned; an event comes out
    as often as windows hold it.
    """
    micros = F.unix_micros(F.col(quoted(time_col)).cast("timestamp"))
    grid = F.array(*[F.lit(a).cast("timestamp_ntz") for a in anchors])
    width = step // timedelta(microseconds=1)
    held = F.filter(
        grid, lambda a: (F.unix_micros(a.cast("timestamp")) < micros) & (F.unix_micros(a.cast("timestamp")) + width >= micros)
    )
    return events.withColumn("timestamp", F.explode(held))
