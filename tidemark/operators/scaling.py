"""Target moments, percentile bounds and metric pivots: small aggregates that models and result tables share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, quoted


def moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., mean, std): sample deviation; one value, or equal ones, count as deviation 1."""
    v = F.col(quoted(column))
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.avg(v).alias("mean"), F.coalesce(F.nullif(F.stddev_samp(v), F.lit(0.0)), F.lit(1.0)).alias("std")
    )


def percentile_bounds(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One row (lo, hi): interpolated percentiles.  Equal values are counted before they meet, so what meets is distinct values."""
    counted = df.groupBy(F.col(quoted(column)).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(*[F.percentile("_v", F.lit(q), F.col("_n")).alias(name) for name, q in (("lo", low), ("hi", high))])


def clamped(df: DataFrame, column: str, bounds: DataFrame, name: str = "clamped") -> DataFrame:
    """The frame with a column held between the one row of bounds."""
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, clamp(F.col(quoted(column)), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def pivot_metrics(long: DataFrame, keys: Sequence[str], split: str, metric: str, value: str, splits: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A row per key with a column ``<split>_<metric>`` for each pair; several values of one are averaged.

    Conditional aggregates, so that one partial aggregation serves all columns and none is missing.
    """
    made = [
        F.avg(F.when((F.col(quoted(split)) == s) & (F.col(quoted(metric)) == m), F.col(quoted(value)))).alias(f"{s}_{m}") for s in splits for m in metrics
    ]
    return long.groupBy(*[quoted(k) for k in keys]).agg(*made)
