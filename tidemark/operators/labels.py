"""Label generation: a user's SQL over anchors and database, with the contract its result must keep."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.operators.numbering import cut
from tidemark.operators.temporal import anchor_frame
from tidemark.plans.dialect import broadcast_kept, merge_joined, to_spark, with_tables
from tidemark.sources.schema import RelDatabase, TaskSpec

ANCHORS = "timestamp_df"

#: Spark's own default threshold.  Bytes of files are held against it; as rows of a hash table, which the driver builds, columns
#: of keys take several times as much.
BROADCAST_MOST = 10 << 20


def too_large(spark: SparkSession, db: RelDatabase, sql: str) -> list[str]:
    """Tables over ``BROADCAST_MOST`` that Spark would broadcast at a higher threshold, by the columns that the query names."""
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if threshold <= BROADCAST_MOST:
        return []
    words = set(re.findall(r"\w+", sql.lower()))
    out = []
    for name, t in db.tables.items():
        if name.lower() not in words:
            continue
        named = t.df.select(*[quoted(c) for c in t.df.columns if c.lower() in words])
        if BROADCAST_MOST < named._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= threshold:
            out.append(name)
    return out


def run_sql(spark: SparkSession, db: RelDatabase, anchors: DataFrame, sql: str, step) -> DataFrame:
    """Run label SQL over the tables under their names; the session's own views of these names stay as they are.

    Tables are registered under names of their own, and the query sees them through common table expressions.  Plans
    capture the views when they are analysed, so the views go at once.
    """
    if ANCHORS in db.tables:
        raise ValueError(f"a table must not be called {ANCHORS}")
    own = f"_tm_{uuid.uuid4().hex}_"
    frames = {ANCHORS: anchors, **{n: t.df for n, t in db.tables.items()}}
    for i, df in enumerate(frames.values()):
        df.createOrReplaceTempView(f"{own}{i}")
    try:
        hinted = merge_joined(broadcast_kept(to_spark(sql, step), ANCHORS), too_large(spark, db, sql))
        return spark.sql(with_tables(hinted, {n: f"{own}{i}" for i, n in enumerate(frames)}))
    finally:
        for i in range(len(frames)):
            spark.catalog.dropTempView(f"{own}{i}")


def make_labels(
    spark: SparkSession, db: RelDatabase, task: TaskSpec, anchors: Sequence[datetime], check: bool = True
) -> DataFrame:
    """(time, entity, target): exactly three columns, a target of whole numbers for classes, null entities left out.

    ``check`` computes the labels once, keeps them as a checkpoint, and looks for repeated (time, entity) pairs there.
    """
    out = run_sql(spark, db, anchor_frame(spark, anchors), task.query, task.timedelta)
    wanted = [task.time_col, task.entity_col, task.target_col]
    if set(out.columns) != set(wanted) or len(out.columns) != 3:
        raise ValueError(f"the query gives {out.columns}; {wanted} are expected")
    target = F.col(quoted(task.target_col))
    kind = "int" if task.kind == "binary_classification" else "double"
    out = out.select(
        F.col(quoted(task.time_col)).cast("timestamp_ntz").alias(task.time_col),
        F.col(quoted(task.entity_col)),
        target.cast(kind).alias(task.target_col),
    ).where(F.col(quoted(task.entity_col)).isNotNull())
    if check:
        out = cut(out)
    if check and (twice := out.groupBy(*[quoted(c) for c in wanted[:2]]).count().where("count > 1").head(1)):
        raise ValueError(f"(time, entity) is not unique: {tuple(twice[0])}")
    return out


def ordered(labels: DataFrame, task: TaskSpec) -> DataFrame:
    """The canonical order, for collection only."""
    return labels.orderBy(quoted(task.time_col), quoted(task.entity_col))
