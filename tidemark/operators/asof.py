"""As-of lookups with a strict bound, without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.columns import age_days, quoted


def asof_lags(
    anchors: DataFrame, pool: DataFrame, entity: str, time: str, value: str, lags: int = 1, row_id: str = "row_id", name: str = "target"
) -> DataFrame:
    """The last ``lags`` pool values strictly before each anchor of the same entity, with their ages in days.

    Anchors and pool are stacked and sorted once by (entity, time); at equal times anchors come first, so a pool row at
    the anchor's own time is not seen.  One shuffle, and no pair of rows is ever formed.  Short history gives nulls.
    """
    names = anchors.columns
    left = anchors.select(
        F.struct(*[F.col(quoted(c)) for c in names]).alias("_row"), F.col(quoted(entity)).alias("_e"), F.col(quoted(time)).alias("_t"),
        F.lit(0).alias("_side"), F.lit(None).cast(pool.schema[value].dataType).alias("_v"), F.col(quoted(row_id)).cast("string").alias("_k"),
    )
    right = pool.select(
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(quoted(entity)).alias("_e"), F.col(quoted(time)).alias("_t"),
        F.lit(1).alias("_side"), F.col(quoted(value)).alias("_v"), F.col(quoted(value)).cast("string").alias("_k"),
    )
    both = left.unionByName(right)
    order = W.partitionBy("_e").orderBy("_t", "_side", "_k")
    seen = F.when(F.col("_side") == 1, F.struct(F.col("_v").alias("v"), F.col("_t").alias("t")))
    frame = order.rowsBetween(W.unboundedPreceding, -1)
    counted = both.withColumn("_s", seen)
    out = counted
    if lags == 1:
        out = out.withColumn("_l1", F.last("_s", ignorenulls=True).over(frame))
    else:
        # Each pool row knows the lags - 1 before it, so the last pool row brings all of them.
        own = W.partitionBy("_e", "_side").orderBy("_t", "_k")
        out = out.withColumn("_all", F.when(F.col("_side") == 1, F.array(F.col("_s"), *[F.lag("_s", k).over(own) for k in range(1, lags)])))
        out = out.withColumn("_last", F.last("_all", ignorenulls=True).over(frame))
        for k in range(1, lags + 1):
            out = out.withColumn(f"_l{k}", F.get("_last", k - 1))
    out = out.where("_side = 0")
    return out.select(
        *[F.col("_row")[c].alias(c) for c in names],
        *[
            x
            for k in range(1, lags + 1)
            for x in (F.col(f"_l{k}.v").alias(f"{name}_lag{k}"), age_days(F.col("_t"), F.col(f"_l{k}.t")).alias(f"{name}_lag{k}_age_days"))
        ],
    )


def lookup_text(rows: DataFrame, key: str, entities: DataFrame, pkey: str, columns: Sequence[str], suffix: str = "__raw_text") -> DataFrame:
    """Raw text columns of the entity each row names; keys are compared as strings, repeated entities count once."""
    # One row of equal keys, the least by its texts, so that the choice does not depend on partitions.
    texts = (
        entities.select(F.col(quoted(pkey)).cast("string").alias("_k"), F.struct(*[F.col(quoted(c)).cast("string").alias(c) for c in columns]).alias("_s"))
        .groupBy("_k").agg(F.min("_s").alias("_s"))
    )
    joined = rows.join(texts, F.col(quoted(key)).cast("string") == F.col("_k"), "left")
    return joined.select(*[F.col(quoted(c)) for c in rows.columns], *[F.col("_s")[c].alias(c + suffix) for c in columns])
