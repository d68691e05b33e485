"""Feature matrices kept on disk: computed once at the greatest depth, sliced for shallower ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.operators import dfs, graph
from tidemark.operators.fingerprint import content_fingerprint, table_checksum, task_fingerprint
from tidemark.sources.cache import CacheConfig, cache_key, cached_artifact, matrix_key
from tidemark.sources.schema import RelDatabase, TaskSpec


def check_rows(matrix: DataFrame, anchors: DataFrame) -> None:
    """A matrix has one row per anchor."""
    if (n := matrix.count()) != (m := anchors.count()):
        raise ValueError(f"{n} matrix rows for {m} anchors")


def cached_features(
    spark: SparkSession, config: CacheConfig, db: RelDatabase, task: TaskSpec, anchors: DataFrame, history: DataFrame | None = None,
    max_depth: int = 4, depth: int | None = None,
) -> DataFrame:
    """Time, entity and features of the anchors up to ``depth``, from the kept matrix of ``max_depth``.

    The place of a matrix follows from schema and content of the database, the task, and checksums of the anchors (without
    their target) and of the history; checksums are taken only where something is kept.
    """
    keys = [task.time_col, task.entity_col]
    plain = anchors.select(*[F.col(quoted(k)) for k in keys]).distinct()

    def compute() -> DataFrame:
        out = dfs.features(plain, db, task.entity_table, task.entity_col, task.time_col, max_depth, history, task.target_col)
        return out.toDF(*[_stored(c) for c in out.columns])

    key = ""
    if config.root is not None and config.policy != "compute":
        past = table_checksum(history, keys) if history is not None else None
        key = matrix_key(content_fingerprint(db), f"{task.name}@{task_fingerprint(task)}", table_checksum(plain, keys), past, max_depth)
    found = cached_artifact(spark, config, key, compute, hint="warm the cache first")
    names = dfs.depths(dfs.with_history(db, history, task.entity_table, task.entity_col, task.time_col) if history is not None else db, task.entity_table, max_depth)
    back = {_stored(n): n for n in names}
    matrix = found.toDF(*[back.get(c, c) for c in found.columns])
    return matrix if depth is None or depth >= max_depth else dfs.at_depth(matrix, names, depth)


def cached_tokens(
    spark: SparkSession, config: CacheConfig, content: str, seeds: DataFrame, edges: DataFrame, pool: DataFrame, k: int, seed: int,
    only: tuple[int, int] | None = None,
) -> DataFrame:
    """(seed_id, tokens) of the seeds with ids ``only`` in [from, to), or of all.

    ``content`` names what edges and pool are made of (``content_fingerprint``).  Rows are kept in the order of their
    seeds, so a range of ids is read from the files and row groups that hold it.  No cache gives the same rows.
    """
    def compute() -> DataFrame:
        made = graph.packed(graph.tokens(seeds, edges, pool, k, seed))
        return made.repartitionByRange("seed_id").sortWithinPartitions("seed_id")

    key = ""
    if config.root is not None and config.policy != "compute":
        key = cache_key(["tokens", "v1", content, f"seeds-{table_checksum(seeds, ['seed_id'])}", f"k-{k}", f"seed-{seed}"])
    found = cached_artifact(spark, config, key, compute, hint="warm the cache first")
    return found if only is None else found.where((F.col("seed_id") >= only[0]) & (F.col("seed_id") < only[1]))


def _stored(name: str) -> str:
    """A column name that any Parquet reader takes."""
    if not set(name) & set(" ,;{}()\n\t="):
        return name
    return "f_" + hashlib.sha1(name.encode()).hexdigest()[:16]
