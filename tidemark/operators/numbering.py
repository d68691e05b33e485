"""Global numbering and lineage cuts without a single task that sees all rows."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the files.

    The folder is what the session names in ``spark.checkpoint.dir``.  Only where that is unset, as in tests, a folder
    beside the warehouse is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(
            spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "checkpoints"
        )
        context.setCheckpointDir(place)
    return df.checkpoint(eager=True)


def range_numbered(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Add ``index`` (from 0, within ``by``) and ``<c>_before`` for each ``c`` in ``sums``, along a global order.

    Rows are range-partitioned by ``by + order``, so a group of any size is spread over partitions.  Each partition's
    counts and sums are taken once, and their running totals (one row a partition and group) are added to what a window
    inside the partition finds.
    """
    keys = [*by, *order]
    placed = cut(
        df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
        .sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    totals = placed.groupBy("_part", *by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums]
    )
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p0"),
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s0_{c}") for c in sums],
    )
    inside = W.partitionBy("_part", *by).orderBy("_row")
    found = placed.select(
        "*",
        (F.row_number().over(inside) - 1).alias("_i"),
        *[
            F.coalesce(F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{c}")
            for c in sums
        ],
    )
    return found.join(offsets, _same_part(by), "inner").select(
        *df.columns,
        (F.col("_i") + F.col("_n0")).cast("long").alias("index"),
        *[(F.col(f"_b_{c}") + F.col(f"_s0_{c}")).alias(f"{c}_before") for c in sums],
    )


def _same_part(by: Sequence[str]) -> Column:
    out = F.col("_part") == F.col("_p0")
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return out
