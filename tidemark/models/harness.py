"""Tuning, selection, refit and result frames."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.base import TaskStats, build, config_id, encode, model_kind, resolve_space
from tidemark.operators.metrics import HIGHER_IS_BETTER, METRICS, evaluate, primary_metric
from tidemark.operators.temporal import Split, concat_labels
from tidemark.sources.cache import CacheConfig
from tidemark.sources.schema import TaskSpec


@dataclass
class Trial:
    tag: str
    config: dict[str, Any]
    val: dict[str, float | None] = field(default_factory=dict)
    test: dict[str, float | None] = field(default_factory=dict)
    fit_s: float = 0.0
    predict_s: float = 0.0
    refit_s: float = 0.0
    error: str | None = None
    selected: bool = False


@dataclass
class Summary:
    model: str
    dataset: str
    task: TaskSpec
    trials: list[Trial]
    tuning_s: float = 0.0

    @property
    def selected(self) -> Trial | None:
        return next((t for t in self.trials if t.selected), None)


def _scores(predicted: DataFrame, target: DataFrame, task: TaskSpec) -> dict[str, float | None]:
    keys = [task.time_col, task.entity_col]
    both = target.join(predicted.select(*keys, "score"), keys, "left")
    return evaluate(both.select(F.col(task.target_col).cast("double").alias("y"), "score"), task.kind)


def run_trial(
    model: str, tag: str, config: Mapping[str, Any], task: TaskSpec, split: Split, seed: int = 0, time_limit: float | None = None,
    cache: CacheConfig | None = None, deepest: int | None = None,
) -> Trial:
    """Fit on train with the validation labels at hand, score on validation; what goes wrong is recorded, not raised."""
    trial = Trial(tag, dict(config))
    try:
        began = time.time()
        fitted = build(model, **config).kept(cache, deepest).fit(task, split.db, split.train, split.target, seed=seed, time_limit=time_limit)
        trial.fit_s, began = time.time() - began, time.time()
        trial.val = _scores(fitted.predict(task, split.db, split.eval), split.target, task)
        trial.predict_s = time.time() - began
    except Exception as e:  # noqa: BLE001  a trial may fail in any way its model does
        trial.error = f"{type(e).__name__}: {e}"
    return trial


def plan(model: str, n_trials: int, seed: int = 0, stats: TaskStats | None = None) -> list[tuple[str, dict[str, Any]]]:
    """Tagged configurations within a budget."""
    return resolve_space(model, stats).tagged(n_trials, seed)


def deepest_of(model: str, n_trials: int, seed: int = 0, stats: TaskStats | None = None) -> int | None:
    """The greatest feature depth of a plan, so that one matrix serves all its trials."""
    return max((c["max_depth"] for _, c in plan(model, n_trials, seed, stats) if "max_depth" in c), default=None)


def tune(
    model: str, task: TaskSpec, split: Split, n_trials: int, seed: int = 0, stats: TaskStats | None = None, time_limit: float | None = None,
    cache: CacheConfig | None = None,
) -> list[Trial]:
    """All trials of the plan; once ``time_limit`` seconds are over no further one begins."""
    until = None if time_limit is None else time.time() + time_limit
    deepest, done = deepest_of(model, n_trials, seed, stats), []
    for tag, config in plan(model, n_trials, seed, stats):
        left = None if until is None else until - time.time()
        if done and left is not None and left <= 0:
            done.append(Trial(tag, dict(config), error="TimeoutError: the time limit was over"))
        else:
            done.append(run_trial(model, tag, config, task, split, seed, left, cache, deepest))
    return done


def select_best(trials: Sequence[Trial], metric: str) -> Trial:
    """The best finite validation score; the first wins ties."""
    best, sign = None, 1 if metric in HIGHER_IS_BETTER else -1
    for t in trials:
        v = t.val.get(metric)
        if t.error is None and v is not None and math.isfinite(v) and (best is None or sign * v > sign * best.val[metric]):
            best = t
    if best is None:
        raise ValueError(f"no trial has a finite {metric}: {[t.error for t in trials]}")
    return best


def refit(
    model: str, trial: Trial, task: TaskSpec, outer: Split, test: DataFrame | None, full: bool = True, seed: int = 0,
    cache: CacheConfig | None = None, deepest: int | None = None,
):
    """Fit on train and validation (or train alone) with the database as of the test cutoff; score if labels are given."""
    began = time.time()
    labels = concat_labels(outer.train, outer.val) if full and outer.val is not None else outer.train
    fitted = build(model, **trial.config).kept(cache, deepest).fit(task, outer.db, labels, None, seed=seed)
    trial.refit_s = time.time() - began
    if test is not None:
        trial.test = _scores(fitted.predict(task, outer.db, outer.eval), test, task)
    return fitted


def run_experiment(
    model: str, dataset: str, task: TaskSpec, inner: Split, outer: Split, test: DataFrame | None = None, n_trials: int = 1, seed: int = 0,
    require_all_trials: bool = True, full: bool = True, cache: CacheConfig | None = None,
) -> Summary:
    """Tune on the inner split, refit the selected and the default configuration on the outer one."""
    began = time.time()
    stats = TaskStats(task.kind, inner.train.count())
    trials = tune(model, task, inner, max(n_trials, 1), seed, stats, cache=cache)
    deepest = deepest_of(model, max(n_trials, 1), seed, stats)
    summary = Summary(model, dataset, task, trials, time.time() - began)
    if (failed := [t for t in trials if t.error]) and require_all_trials:
        raise RuntimeError(f"{len(failed)} trials failed: {failed[0].error}")
    best = select_best(trials, primary_metric(task.kind))
    best.selected = True
    for trial in (t for t in trials if (t is best or t.tag == "default") and not t.error):
        refit(model, trial, task, outer, test, full, seed, cache, deepest)
    return summary


RESULT_SCHEMA = (
    "model string, kind string, dataset string, task string, metric string, tag string, config_id string, config string, selected boolean, error string, "
    "test_score double, fit_time_tuning double, fit_time_refit double, predict_time_refit double, "
    + ", ".join(f"val_{m} double, test_{m} double" for m in METRICS)
)


def to_frame(spark: SparkSession, summaries: Sequence[Summary]) -> DataFrame:
    """One row per configuration."""
    rows = []
    for s in summaries:
        metric = primary_metric(s.task.kind)
        for t in s.trials:
            row = [s.model, model_kind(s.model), s.dataset, s.task.name, metric, t.tag, config_id(t.config), encode(t.config), t.selected, t.error,
                   t.test.get(metric), s.tuning_s, t.refit_s, t.predict_s]
            for m in METRICS:
                row += [t.val.get(m), t.test.get(m)]
            rows.append(tuple(row))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def note(text: str) -> None:
    warnings.warn(text, stacklevel=3)
