"""The predictive query: declare a database and a question, fit a model, predict, back-test."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark.models.builtin  # noqa: F401  registers the models
from tidemark.functions.columns import quoted
from tidemark.models.base import Model, TaskStats, build, resolve_space
from tidemark.models.harness import Trial, deepest_of, note, refit, select_best, tune
from tidemark.operators import keys, temporal
from tidemark.operators.fingerprint import content_fingerprint, task_fingerprint
from tidemark.operators.labels import make_labels
from tidemark.operators.metrics import primary_metric
from tidemark.sources.cache import CacheConfig, cached_frame
from tidemark.sources.schema import QuerySpec, RelDatabase, read_database


@dataclass
class PredictiveQuery:
    """``PredictiveQuery(spark, spec).fit("dfs-gbt").predict()``.

    With ``rekey`` all keys become dense ids inside, and predictions carry the outer ids again.
    """

    spark: SparkSession
    spec: QuerySpec
    rekey: bool = False
    db: RelDatabase | None = None
    model: Model | None = None
    trials: list[Trial] = field(default_factory=list)

    def __post_init__(self) -> None:
        d = self.spec.database
        if d.val_timestamp is None or d.test_timestamp is None or d.val_timestamp >= d.test_timestamp:
            raise ValueError("the database names val_timestamp before test_timestamp")
        db = self.db if self.db is not None else read_database(self.spark, d)
        self._maps: dict[str, DataFrame] = {}
        if self.rekey:
            db, self._maps = keys.rekey(db)
        self.db = keys.clean_columns(db, d.name)

    def labels(self, cache_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Train and validation labels, on data up to the test cutoff.

        Kept labels lie under what they follow from: the task with its SQL, the anchors, and the tables' content.
        """
        d, task = self.spec.database, self.spec.task
        censored = self.db.upto(d.test_timestamp)
        earliest = censored.time_bounds()[0]
        if earliest is None:
            raise ValueError("no table has a time")
        content = content_fingerprint(censored) if cache_dir else ""

        def made(split: str, anchors: Sequence[datetime]) -> DataFrame:
            build = lambda: make_labels(self.spark, censored, task, anchors)
            if not cache_dir:
                return build()
            at = hashlib.blake2s(repr(anchors).encode(), digest_size=8).hexdigest()
            return cached_frame(self.spark, cache_dir, ["labels", content, f"{task.name}@{task_fingerprint(task)}", f"{split}-{at}"], build)

        return (
            made("train", temporal.train_anchors(d.val_timestamp, task.timedelta, earliest)),
            made("val", temporal.eval_anchors(d.val_timestamp, task.timedelta, task.n_eval, d.test_timestamp)),
        )

    def precompute_cache(self, cache_dir: str, max_depth: int = 4) -> list[str]:
        """Compute and keep the labels and matrices that ``fit(cache_dir=...)`` reads."""
        from tidemark.models.warm import warm

        return warm(self.spark, self.spec, CacheConfig(cache_dir), max_depth)

    def fit(
        self, model: str = "dfs-gbt", n_trials: int = 0, seed: int = 0, cache_dir: str | None = None, full: bool = True, time_limit: float | None = None
    ) -> PredictiveQuery:
        """Tune if asked to, then fit on train and validation labels with the database as of the test cutoff.

        With ``cache_dir`` labels and feature matrices are kept there.  ``time_limit`` is for the trials, in seconds.
        """
        d, task = self.spec.database, self.spec.task
        train, val = self.labels(cache_dir)
        cache = CacheConfig(cache_dir)
        deepest = None
        if n_trials > 0:
            inner = temporal.inner_split(self.db, task.entity_table, task.entity_col, train, val, d.val_timestamp, task.target_col)
            stats = TaskStats(task.kind, inner.train.count())
            deepest = deepest_of(model, n_trials, seed, stats)
            self.trials = tune(model, task, inner, n_trials, seed, stats, time_limit, cache)
            best = select_best(self.trials, primary_metric(task.kind))
            best.selected = True
        else:
            best = Trial("default", dict(resolve_space(model, TaskStats(task.kind, 0)).default))
            build(model, **best.config)
        outer = temporal.outer_split(self.db, task.entity_table, task.entity_col, train, val, val.limit(0), d.test_timestamp, task.target_col)
        self.model = refit(model, best, task, outer, None, full, seed, cache, deepest)
        return self

    def predict(self, at: datetime | None = None, entities: Sequence[Any] | DataFrame | str | None = None) -> DataFrame:
        """(entity, time, ``<target>_pred``) at an anchor; the database stays frozen at the test cutoff for later ones."""
        if self.model is None:
            raise ValueError("fit first")
        d, task = self.spec.database, self.spec.task
        at = at or self.spec.at or d.test_timestamp
        entities = self.spec.entities if entities is None else entities
        if at > d.test_timestamp:
            note(f"{at} is after {d.test_timestamp}; the database stays as of the latter")
        frozen = temporal.freeze(self.db, min(at, d.test_timestamp))
        if self.rekey:
            entities = keys.to_internal(entities, self._maps[task.entity_table])
        seeds = temporal.prediction_seeds(frozen, task.entity_table, task.entity_col, task.time_col, at, entities)
        out = self.model.predict(task, frozen, seeds).select(
            quoted(task.entity_col), quoted(task.time_col), F.col("score").alias(f"{task.target_col}_pred")
        )
        return keys.to_external(out, task.entity_col, self._maps[task.entity_table]) if self.rekey else out

    def compute_test_labels(self, data_end: datetime | None = None) -> DataFrame:
        """Labels of the test anchors on the full data, which must reach the last window's end."""
        d, task = self.spec.database, self.spec.task
        temporal.check_coverage(self.db, d.test_timestamp, task.timedelta, task.n_eval, data_end)
        out = make_labels(self.spark, self.db, task, temporal.eval_anchors(d.test_timestamp, task.timedelta, task.n_eval))
        return keys.to_external(out, task.entity_col, self._maps[task.entity_table]) if self.rekey else out
