"""Artifacts kept as Parquet: written beside their place and renamed when complete."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

RAISE, FILL, COMPUTE = "raise", "fill", "compute"


@dataclass(frozen=True)
class CacheConfig:
    """Where artifacts lie, and what a missing one means: an error, filling it, or computing without keeping it."""

    root: str | None = None
    policy: str = FILL


def cache_key(segments: Sequence[str]) -> str:
    """A relative path of plain segments; anything that could leave the root is refused."""
    for s in segments:
        if not s or s in (".", "..") or not re.fullmatch(r"[\w.@=+-]+", s):
            raise ValueError(f"not a plain cache segment: {s!r}")
    return "/".join(segments)


def resolve_cache(root: str | None = None, variable: str = "TIDEMARK_CACHE", policy: str = FILL) -> CacheConfig:
    """The argument, else the environment; ``off``, ``0`` and an empty value switch it off."""
    root = root if root is not None else os.environ.get(variable)
    return CacheConfig(None, COMPUTE) if root is None or root.lower() in ("", "0", "off", "none") else CacheConfig(root, policy)


def matrix_key(content: str, task: str, anchors: str, history: str | None, max_depth: int, version: int = 2) -> str:
    """Place of a feature matrix: what it is computed from, without the target."""
    return cache_key(["dfs", f"v{version}", content, task, f"anchors-{anchors}", f"history-{history or 'none'}", f"max-depth-{max_depth}"])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, path_of = _fs(spark, path)
    return fs.exists(path_of(f"{path}/_SUCCESS"))


def cached_artifact(
    spark: SparkSession, config: CacheConfig, key: str, build: Callable[[], DataFrame], validate: Callable[[DataFrame], bool] | None = None, hint: str = ""
) -> DataFrame:
    """Read what is there, else act by the policy.  A write goes to a staging folder and is renamed when it is complete."""
    if config.root is None or config.policy == COMPUTE:
        return build()
    place = f"{config.root}/{key}"
    if exists(spark, place):
        out = spark.read.parquet(place)
        if validate is None or validate(out):
            return out
    if config.policy == RAISE:
        raise FileNotFoundError(f"{place} is not there. {hint}".strip())
    staging = f"{config.root}/.staging/{uuid.uuid4().hex}"
    build().write.parquet(staging)
    fs, path_of = _fs(spark, place)
    fs.mkdirs(path_of(place).getParent())
    if exists(spark, place):  # it is there but not valid, or another filler was first
        if validate is None or validate(spark.read.parquet(place)):
            fs.delete(path_of(staging), True)
            return spark.read.parquet(place)
        _move(spark, place, f"{config.root}/.staging/{uuid.uuid4().hex}")
    if not _move(spark, staging, place):
        fs.delete(path_of(staging), True)
        if not exists(spark, place):
            raise OSError(f"cannot publish {place}")
    return spark.read.parquet(place)


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """An atomic rename that does not replace: false where the target is there already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.NONE
    _, path_of = _fs(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path_of(source).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(path_of(source), path_of(target), how)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "ParentNotDirectoryException", "IOException"):
            return False
        raise
    return True


def cached_frame(spark: SparkSession, root: str, segments: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    return cached_artifact(spark, CacheConfig(root), cache_key(segments), build)
