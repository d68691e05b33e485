"""Constant models: one value for all rows, or one for each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted


def _centre(target: str, kind: str) -> Column:
    """The share of ones for classes, the median for numbers."""
    c = F.col(quoted(target)).cast("double")
    return F.avg(c) if kind == "binary_classification" else F.median(c)


def constant_scores(train: DataFrame, rows: DataFrame, target: str, kind: str) -> DataFrame:
    """``rows`` with a ``score`` that is the same for all."""
    return rows.crossJoin(F.broadcast(train.agg(_centre(target, kind).alias("score"))))


def entity_scores(train: DataFrame, rows: DataFrame, entity: str, target: str, kind: str) -> DataFrame:
    """``rows`` with the score of their entity, or the overall one for entities that training never saw."""
    own = train.groupBy(F.col(quoted(entity)).alias("_e")).agg(_centre(target, kind).alias("_own"))
    overall = train.agg(_centre(target, kind).alias("_all"))
    joined = rows.join(own, F.col(quoted(entity)) == F.col("_e"), "left").crossJoin(F.broadcast(overall))
    return joined.select(*[F.col(quoted(c)) for c in rows.columns], F.coalesce("_own", "_all").alias("score"))
