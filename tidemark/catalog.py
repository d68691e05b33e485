"""All relational queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

AREAS = ("labels", "keys", "features", "evaluation", "graphs", "pipelines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for area in AREAS:
        out |= import_module(f"tidemark.suites.{area}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for area in AREAS:
        out |= import_module(f"tidemark.suites.{area}").ORACLES
    return out
