"""Export of a database with its splits, eviction of old exports, a content-keyed text store, and result sinks."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.sources.schema import RelDatabase, TaskSpec


def write_dataset(folder: str, name: str, db: RelDatabase, task: TaskSpec, splits: Mapping[str, DataFrame]) -> dict:
    """``tables/<t>.parquet``, ``splits/<s>.parquet`` and a manifest; a masked split gets a constant 0 target of the training type."""
    train = splits["train"]
    kind = train.schema[task.target_col].dataType
    manifest = {"name": name, "task": {"name": task.name, "kind": task.kind, "entity": task.entity_table, "target": task.target_col}, "tables": {}, "splits": {}}
    for table, t in db.tables.items():
        t.df.write.mode("overwrite").parquet(f"{folder}/tables/{table}.parquet")
        manifest["tables"][table] = {"pkey": t.pkey, "time_col": t.time_col, "fkeys": dict(t.fkeys), "columns": t.df.columns}
    for split, df in splits.items():
        masked = task.target_col not in df.columns
        out = df.withColumn(task.target_col, F.lit(0).cast(kind)) if masked else df
        out.select(*[quoted(c) for c in train.columns]).write.mode("overwrite").parquet(f"{folder}/splits/{split}.parquet")
        manifest["splits"][split] = {"masked": masked}
    spark = train.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def claim(export: Path) -> None:
    """Mark an export as in use by this process."""
    (export / f".claim-{os.getpid()}").touch()
    os.utime(export)


def reap(root: str | Path, free_target: int, free=lambda p: shutil.disk_usage(p).free) -> list[str]:
    """Delete exports, least recently used first, until enough space is free; those claimed by live processes stay."""
    gone = []
    for export in sorted((p for p in Path(root).iterdir() if p.is_dir()), key=lambda p: p.stat().st_mtime):
        if free(root) >= free_target:
            break
        if any(Path(f"/proc/{c.name.rpartition('-')[2]}").exists() for c in export.glob(".claim-*")):
            continue
        shutil.rmtree(export)
        gone.append(export.name)
    return gone


def text_store(texts: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(key, text): distinct texts by content hash that the store does not have yet."""
    fresh = texts.where(F.col(quoted(column)).isNotNull()).select(F.sha2(F.col(quoted(column)), 256).alias("key"), F.col(quoted(column)).alias("text"))
    fresh = fresh.groupBy("key").agg(F.first("text").alias("text"))
    return fresh if known is None else fresh.join(known.select("key"), "key", "left_anti")


def write_results(results: DataFrame, path: str) -> None:
    results.coalesce(1).write.mode("overwrite").csv(path, header=True)


