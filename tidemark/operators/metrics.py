"""Metrics as aggregates over (y, score), and the error that all of them are turned into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import range_numbered

HIGHER_IS_BETTER = {"roc_auc", "average_precision", "accuracy", "f1", "r2"}
METRICS = (*sorted(HIGHER_IS_BETTER), "mae", "rmse")
PRIMARY = {"binary_classification": "roc_auc", "regression": "mae"}


def primary_metric(kind: str) -> str:
    return PRIMARY[kind]


def to_error(metric: Column | str, score: Column) -> Column:
    name = metric if isinstance(metric, Column) else F.lit(metric)
    return F.when(name.isin(*sorted(HIGHER_IS_BETTER)), 1.0 - score).otherwise(score)


def by_score(df: DataFrame) -> DataFrame:
    """Rows per distinct score with running counts from the highest score down: what both ranking metrics need.

    Scores are counted first; running counts come from per-partition totals, so no task sees all scores.
    """
    grouped = df.groupBy((-F.col("score")).alias("down")).agg(F.sum("y").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    placed = range_numbered(grouped, ["down"], sums=["pos", "n"])
    total = grouped.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    return placed.withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn("seen", F.col("n_before") + F.col("n")).crossJoin(F.broadcast(total))


def ranking(df: DataFrame) -> DataFrame:
    """roc_auc (mid-ranks; null with one class) and average_precision (tied scores step together)."""
    negative = F.col("n") - F.col("pos")
    return by_score(df).agg(
        (F.sum(negative * (F.col("pos_before") + F.col("pos") / 2)) / F.nullif(F.first("all_pos") * (F.first("all_n") - F.first("all_pos")), F.lit(0.0))).alias("roc_auc"),
        (F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.first("all_pos"), F.lit(0.0))).alias("average_precision"),
    )


def threshold(df: DataFrame, at: float = 0.5) -> DataFrame:
    """accuracy and f1 of ``score >= at``."""
    hit = (F.col("score") >= at).cast("int")
    tp = F.sum(hit * F.col("y"))
    return df.agg(
        F.avg((hit == F.col("y")).cast("double")).alias("accuracy"),
        F.coalesce(2.0 * tp / F.nullif(F.sum(hit) + F.sum("y"), F.lit(0)), F.lit(0.0)).alias("f1"),
    )


def regression(df: DataFrame) -> DataFrame:
    """mae, rmse and r2."""
    gap = F.col("y") - F.col("score")
    total = F.var_pop("y") * F.count("y")
    return df.agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1.0 - F.sum(gap * gap) / F.nullif(total, F.lit(0.0))).alias("r2"),
    )


def evaluate(df: DataFrame, kind: str) -> dict[str, float | None]:
    """All metrics of a kind from a frame with ``y`` and ``score``; one small row per job comes back."""
    if kind == "regression":
        return regression(df).first().asDict()
    return ranking(df).first().asDict() | threshold(df).first().asDict()
