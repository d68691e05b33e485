"""Context sampling.  Every draw is an order by an MD5 key over (seed, stream, row), so it is the same on any cluster."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import int60, quoted, unit_key
from tidemark.operators.numbering import range_numbered


def _top(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows: a top-k per partition and a merge, so no task sorts everything."""
    return df.orderBy(*order).limit(n)


def recency_rank(df: DataFrame, time: str, row_id: str) -> DataFrame:
    """``rank`` 0 is the most recent row; ties by row id."""
    keyed = df.withColumn("_late", -F.unix_micros(F.col(quoted(time)).cast("timestamp")))
    return range_numbered(keyed, ["_late", row_id]).drop("_late").withColumnRenamed("index", "rank")


def _estimators(spark, n: int) -> DataFrame:
    return F.broadcast(spark.range(n).select(F.col("id").cast("int").alias("est")))


def hard_pool(df: DataFrame, time: str, row_id: str, k: int, m: int, n_estimators: int, seed: int) -> DataFrame | None:
    """(est, row_id): K rows for each estimator from the M most recent; None when there are M rows or fewer."""
    if df.limit(m + 1).count() <= m:
        return None
    pool = _top(df.select(quoted(row_id), quoted(time)), [F.col(quoted(time)).desc(), F.col(quoted(row_id))], m)
    drawn = pool.crossJoin(_estimators(df.sparkSession, n_estimators)).withColumn("_key", int60(seed, F.col("est"), F.col(quoted(row_id))))
    order = W.partitionBy("est").orderBy("_key", quoted(row_id))
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("est", quoted(row_id))


def soft_pool(df: DataFrame, time: str, row_id: str, k: int, m: int, n_estimators: int, seed: int, tau: float = 0.25) -> DataFrame | None:
    """As ``hard_pool``, from a pool of M rows drawn with weights that halve every ``tau`` of the recency ranks.

    The pool is the M largest ``ln(u) / w`` with a uniform ``u`` per row (weighted draws without replacement).
    """
    n = df.count()
    if n <= m:
        return None
    ranked = recency_rank(df.select(quoted(row_id), quoted(time)), time, row_id)
    weight = F.exp(F.lit(-log(2.0) / tau) * (F.col("rank") / F.lit(max(n - 1, 1))))
    keyed = ranked.withColumn("_pool", F.log(unit_key(seed, "pool", F.col(quoted(row_id)))) / weight)
    pool = _top(keyed, [F.col("_pool").desc(), F.col(quoted(row_id))], m).select(quoted(row_id))
    drawn = pool.crossJoin(_estimators(df.sparkSession, n_estimators)).withColumn("_key", int60(seed, F.col("est"), F.col(quoted(row_id))))
    order = W.partitionBy("est").orderBy("_key", quoted(row_id))
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("est", quoted(row_id))


def union_positions(drawn: DataFrame, row_id: str) -> DataFrame:
    """(est, row_id, position): places of the drawn rows in the sorted union of all draws."""
    union = drawn.select(quoted(row_id)).distinct()
    placed = range_numbered(union, [row_id]).withColumnRenamed("index", "position")
    return drawn.join(placed, row_id).select("est", quoted(row_id), "position")


def random_cap(df: DataFrame, row_id: str, most: int, seed: int, target: str | None = None) -> DataFrame:
    """At most ``most`` rows, drawn evenly; with a target, one row of every class comes first."""
    if df.limit(most + 1).count() <= most:
        return df
    keyed = df.withColumn("_key", int60(seed, F.col(quoted(row_id))))
    if target is None:
        return _top(keyed, [F.col("_key"), F.col(quoted(row_id))], most).drop("_key")
    firsts = keyed.groupBy(quoted(target)).agg(F.min(F.struct("_key", quoted(row_id))).alias("_f")).select(F.col(f"_f.{quoted(row_id)}").alias("_first"))
    marked = keyed.join(F.broadcast(firsts), F.col(quoted(row_id)) == F.col("_first"), "left")
    return _top(marked, [F.col("_first").isNull(), F.col("_key"), F.col(quoted(row_id))], most).drop("_key", "_first")
