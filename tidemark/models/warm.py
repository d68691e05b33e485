"""Cache warmers: the matrices that a fit will ask for, computed ahead."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.models.matrices import cached_features, check_rows
from tidemark.operators import temporal
from tidemark.query import PredictiveQuery
from tidemark.sources.cache import CacheConfig
from tidemark.sources.schema import QuerySpec


def warm(spark: SparkSession, spec: QuerySpec, config: CacheConfig, max_depth: int = 4) -> list[str]:
    """Fill the cache for the tuning split and for the final fit, as ``dfs-gbt`` reads them with a grid ``max_depth`` deep."""
    q = PredictiveQuery(spark, spec)
    d, task = spec.database, spec.task
    train, val = q.labels(config.root)
    inner = temporal.inner_split(q.db, task.entity_table, task.entity_col, train, val, d.val_timestamp, task.target_col)
    outer = temporal.outer_split(q.db, task.entity_table, task.entity_col, train, val, val, d.test_timestamp, task.target_col)
    full = temporal.concat_labels(outer.train, outer.val)
    past = [task.time_col, task.entity_col, task.target_col]
    tried = inner.train.select(past).unionByName(inner.target.select(past))
    done = []
    for phase, split, anchors, history in (
        ("tuning", inner, tried, inner.train), ("validation", inner, inner.eval, inner.train), ("final", outer, full, full),
    ):
        check_rows(cached_features(spark, config, split.db, task, anchors, history.select(past), max_depth), anchors)
        done.append(phase)
    return done
