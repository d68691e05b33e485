"""Relational data model: tables with declared keys and times, databases of them, and their YAML declarations."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted


@dataclass(frozen=True)
class RelTable:
    """A frame with its primary key, foreign keys (column to table) and time column; keys are metadata only."""

    df: DataFrame
    pkey: str | None = None
    fkeys: Mapping[str, str] = field(default_factory=dict)
    time_col: str | None = None

    def with_df(self, df: DataFrame) -> RelTable:
        return replace(self, df=df)


@dataclass(frozen=True)
class RelDatabase:
    tables: Mapping[str, RelTable]

    def __getitem__(self, name: str) -> RelTable:
        return self.tables[name]

    def upto(self, cutoff: datetime) -> RelDatabase:
        """Rows with time up to and including the cutoff; tables without time stay whole."""
        return RelDatabase(
            {
                n: t if t.time_col is None else t.with_df(t.df.where(F.col(quoted(t.time_col)) <= F.lit(cutoff).cast("timestamp_ntz")))
                for n, t in self.tables.items()
            }
        )

    def time_bounds(self) -> tuple[datetime | None, datetime | None]:
        """Earliest and latest time over all timed tables: one row a table comes back."""
        low, high = [], []
        for t in self.tables.values():
            if t.time_col:
                c = F.col(quoted(t.time_col)).cast("timestamp_ntz")
                a, b = t.df.agg(F.min(c), F.max(c)).first()
                low += [a] if a else []
                high += [b] if b else []
        return min(low, default=None), max(high, default=None)

    def register(self) -> None:
        for name, t in self.tables.items():
            t.df.createOrReplaceTempView(name)


@dataclass(frozen=True)
class TableSpec:
    path: str
    pkey: str | None = None
    time_col: str | None = None
    fkeys: Mapping[str, str] = field(default_factory=dict)
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class DatabaseSpec:
    name: str
    tables: Mapping[str, TableSpec]
    val_timestamp: datetime | None = None
    test_timestamp: datetime | None = None

    @classmethod
    def from_yaml(cls, path: str | Path, data_dir: str | Path | None = None) -> DatabaseSpec:
        """Table paths default to ``<name>.parquet``; relative ones lie in ``data_dir`` or beside the file.

        A file either has ``name``, ``tables`` and the two cutoffs, or is a mapping of tables alone.
        """
        path = Path(path)
        raw = yaml.safe_load(path.read_text())
        if isinstance(raw, Mapping) and not isinstance(raw.get("tables"), Mapping):  # tables at the top, named after the folder
            raw = {"name": path.parent.name or path.stem, "tables": dict(raw)}
        raw = check(raw, _DATABASE, "database")
        raw["tables"] = {n: t or {} for n, t in raw["tables"].items()}
        base = Path(data_dir) if data_dir is not None else path.parent
        tables = {}
        for name, t in raw["tables"].items():
            t = t or {}
            place = t.get("path", f"{name}.parquet")
            place = place if "://" in place or Path(place).is_absolute() else str(base / place)
            columns = t.get("columns")
            tables[name] = TableSpec(place, t.get("pkey"), t.get("time_col"), dict(t.get("fkeys") or {}), tuple(columns) if columns else None)
        return cls(raw["name"], tables, _time(raw.get("val_timestamp")), _time(raw.get("test_timestamp")))


@dataclass(frozen=True)
class TaskSpec:
    name: str
    kind: str
    entity_table: str
    entity_col: str
    time_col: str
    target_col: str
    timedelta: timedelta
    query: str
    n_eval: int = 1

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> TaskSpec:
        raw = check(raw, _TASK, "task")
        if raw["kind"] not in ("binary_classification", "regression"):
            raise ValueError(f"unknown kind {raw['kind']!r}")
        return cls(
            raw["name"], raw["kind"], raw["entity_table"], raw["entity_col"], raw.get("time_col", "timestamp"),
            raw["target_col"], parse_step(raw["timedelta"]), raw["query"], int(raw.get("n_eval", 1)),
        )


@dataclass(frozen=True)
class QuerySpec:
    """A predictive question: a database declaration, a task on it, and whom to predict when (all, at the test cutoff)."""

    database: DatabaseSpec
    task: TaskSpec
    entities: Any = "all"
    at: datetime | None = None

    @classmethod
    def from_yaml(cls, path: str | Path, data_dir: str | Path | None = None) -> QuerySpec:
        """The ``database`` entry is resolved relative to the task file.

        A task may name its own ``val_timestamp`` and ``test_timestamp``, and ``entities`` and ``at_timestamp`` for its
        predictions; ``task_type`` and ``num_eval_timestamps`` are other names of ``kind`` and ``n_eval``.
        """
        path = Path(path)
        raw = dict(yaml.safe_load(path.read_text()))
        database = raw.pop("database", None)
        if not database:
            raise ValueError("a task file names its database")
        spec = DatabaseSpec.from_yaml(path.parent / database, data_dir)
        given = {k: _time(raw.pop(k)) for k in ("val_timestamp", "test_timestamp") if k in raw}
        entities, at = raw.pop("entities", "all"), _time(raw.pop("at_timestamp", None))
        for old, new in (("task_type", "kind"), ("num_eval_timestamps", "n_eval")):
            if old in raw:
                raw[new] = raw.pop(old)
        raw.setdefault("name", path.stem)
        return cls(replace(spec, **given), TaskSpec.from_dict(raw), entities, at)


_DATABASE = {"name": str, "tables": dict, "val_timestamp": object, "test_timestamp": object}
_TASK = {
    "name": str, "kind": str, "entity_table": str, "entity_col": str, "time_col": str, "target_col": str,
    "timedelta": object, "query": str, "n_eval": int,
}
_TABLE = {"path": str, "pkey": str, "time_col": str, "fkeys": dict, "columns": list}
_OPTIONAL = {"val_timestamp", "test_timestamp", "time_col", "n_eval"}


def check(raw: Any, fields: Mapping[str, type], what: str) -> dict[str, Any]:
    """Reject unknown keys, missing keys and wrong kinds; a table declared as null takes all defaults."""
    if not isinstance(raw, Mapping):
        raise ValueError(f"{what}: a mapping is expected")
    if unknown := set(raw) - set(fields):
        raise ValueError(f"{what}: unknown keys {sorted(unknown)}")
    if missing := set(fields) - _OPTIONAL - set(raw):
        raise ValueError(f"{what}: missing keys {sorted(missing)}")
    for k, v in raw.items():
        if not isinstance(v, fields[k]):
            raise ValueError(f"{what}: {k} must be {fields[k].__name__}")
    if what == "database":
        for name, t in raw["tables"].items():
            t = t or {}
            if unknown := set(t) - set(_TABLE):
                raise ValueError(f"table {name}: unknown keys {sorted(unknown)}")
            for k, v in t.items():
                if not isinstance(v, _TABLE[k]):
                    raise ValueError(f"table {name}: {k} must be {_TABLE[k].__name__}")
            for parent in (t.get("fkeys") or {}).values():
                if parent not in raw["tables"]:
                    raise ValueError(f"table {name}: unknown parent {parent}")
    return dict(raw)


def _time(value: Any) -> datetime | None:
    if value is None or isinstance(value, datetime):
        return value
    return datetime.fromisoformat(str(value))


def parse_step(value: Any) -> timedelta:
    """``30 days``, ``12 hours``, ``90 minutes`` or ``600 seconds``; a bare number counts days."""
    if isinstance(value, timedelta):
        return value
    if isinstance(value, (int, float)):
        return timedelta(days=value)
    number, _, unit = str(value).strip().partition(" ")
    unit = unit.strip().rstrip("s") or "day"
    units = {"day": 86400, "hour": 3600, "minute": 60, "second": 1, "week": 604800}
    if unit not in units:
        raise ValueError(f"unknown time unit in {value!r}")
    return timedelta(seconds=float(number) * units[unit])


def read_table(spark: SparkSession, spec: TableSpec, name: str = "") -> RelTable:
    """Parquet or CSV by suffix; only declared columns are read; the time column is parsed."""
    path = spec.path
    if path.endswith((".csv", ".csv.gz", ".tsv")):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if ".tsv" in path else ",")
    else:
        df = spark.read.parquet(path)
    if spec.columns is not None:
        needed = [c for c in (spec.pkey, spec.time_col, *spec.fkeys) if c]
        if unlisted := [c for c in needed if c not in spec.columns]:
            raise ValueError(f"table {name}: keys and times must be listed in columns: {unlisted}")
        if absent := [c for c in spec.columns if c not in df.columns]:
            raise ValueError(f"table {name}: no such columns: {absent}")
        df = df.select(*[F.col(quoted(c)) for c in spec.columns])
    for c in (spec.pkey, spec.time_col, *spec.fkeys):
        if c and c not in df.columns:
            raise ValueError(f"table {name}: no column {c}")
    if spec.time_col:
        df = df.withColumn(spec.time_col, F.col(quoted(spec.time_col)).cast("timestamp_ntz"))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            c = F.col(quoted(f.name))
            df = df.withColumn(f.name, F.when(~F.isnan(c), c))
    return RelTable(df, spec.pkey, dict(spec.fkeys), spec.time_col)


def read_database(spark: SparkSession, spec: DatabaseSpec) -> RelDatabase:
    return RelDatabase({n: read_table(spark, t, n) for n, t in spec.tables.items()})


def materialize(db: RelDatabase, folder: str) -> None:
    """Every table, uncensored, as Parquet in a folder of its own."""
    for name, t in db.tables.items():
        t.df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def derived_time(child: RelTable, parent: RelTable, fkey: str, time_col: str) -> RelTable:
    """Give a table without time the time of the parent row that its key names."""
    if parent.pkey is None or parent.time_col is None:
        raise ValueError("the parent needs a key and a time")
    times = parent.df.select(F.col(quoted(parent.pkey)).alias("_k"), F.col(quoted(parent.time_col)).alias(time_col))
    joined = child.df.join(times, F.col(quoted(fkey)) == F.col("_k"), "left").drop("_k")
    return replace(child, df=joined, time_col=time_col)


def warn(text: str) -> None:
    warnings.warn(text, stacklevel=3)
