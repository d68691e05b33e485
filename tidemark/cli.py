"""Command line: run models over task files and write a results table."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.models import harness
from tidemark.models.base import discover, model_names
from tidemark.operators import temporal
from tidemark.query import PredictiveQuery
from tidemark.sources.cache import CacheConfig
from tidemark.sources.export import write_results
from tidemark.sources.schema import QuerySpec


def find_tasks(folder: str | Path, kinds: Sequence[str] | None = None) -> dict[str, Path]:
    """Task files under a folder, by ``<folder>/<task>``, without loading data."""
    out = {}
    for p in sorted(Path(folder).rglob("*.y*ml")):
        try:
            spec = QuerySpec.from_yaml(p)
        except (ValueError, TypeError, OSError):
            continue
        if kinds is None or spec.task.kind in kinds:
            out[f"{p.parent.name}/{p.stem}"] = p
    return out


def run_task(spark: SparkSession, spec: QuerySpec, model: str, n_trials: int, seed: int, test: bool, cache_dir: str | None = None) -> harness.Summary:
    q = PredictiveQuery(spark, spec)
    d, task = spec.database, spec.task
    train, val = q.labels(cache_dir)
    target = q.compute_test_labels() if test else None
    inner = temporal.inner_split(q.db, task.entity_table, task.entity_col, train, val, d.val_timestamp, task.target_col)
    outer = temporal.outer_split(q.db, task.entity_table, task.entity_col, train, val, target if test else val.limit(0), d.test_timestamp, task.target_col)
    return harness.run_experiment(model, d.name, task, inner, outer, target, n_trials, seed, cache=CacheConfig(cache_dir))


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--model", action="append", help="model name; may be given again")
    p.add_argument("--models-from", action="append", default=[], help="package whose modules register models; may be given again")
    p.add_argument("--datasets", nargs="*", help="folders of task files to keep")
    p.add_argument("--tasks", default="tasks", help="folder of task files")
    p.add_argument("--data-dir", help="folder of the tables, instead of beside the database file")
    p.add_argument("--kinds", nargs="*", help="kinds of task to keep")
    p.add_argument("--cache-dir", help="folder in which feature matrices are kept")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--n-trials", type=int, default=1)
    p.add_argument("--no-test", action="store_true", help="leave test labels alone")
    p.add_argument("--list", action="store_true", help="list models and tasks")
    p.add_argument("--output", default="results.csv")
    a = p.parse_args(argv)
    for package in a.models_from:
        for module, gone in discover(package).items():
            print(f"{package}.{module} is left out: it needs {gone}")
    tasks = {k: v for k, v in find_tasks(a.tasks, a.kinds).items() if not a.datasets or k.split("/")[0] in a.datasets}
    if a.list:
        print("\n".join([*[f"model {m}" for m in model_names()], *[f"task {t}" for t in tasks]]))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done, failed = [], 0
    for name, path in tasks.items():
        for model in a.model or ["dfs-gbt"]:
            try:
                done.append(run_task(spark, QuerySpec.from_yaml(path, a.data_dir), model, a.n_trials, a.seed, not a.no_test, a.cache_dir))
            except Exception as e:  # noqa: BLE001  one task's failure must not end the others
                failed += 1
                print(f"{name} {model}: {type(e).__name__}: {e}")
    if done:
        write_results(harness.to_frame(spark, done), a.output)
    return 1 if failed and not done else 0


if __name__ == "__main__":
    raise SystemExit(main())
