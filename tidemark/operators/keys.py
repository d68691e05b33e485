"""Keys: dense re-keying, remapping of references, duplicate and null checks, column cleaning, id translation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.operators.numbering import range_numbered
from tidemark.sources.schema import RelDatabase, RelTable, warn

# Columns computed over a whole rating history, by database and table; they tell of times after a row's own.
LEAKING = {
    "rel-ratebeer": {
        "users": ("max_beer_rating", "min_beer_rating", "max_place_rating", "min_place_rating", "place_first_rating", "place_last_rating"),
    },
}


def dense_ids(table: RelTable, order: Sequence[str] = ()) -> DataFrame:
    """(old, new): ids 0..n-1 in order of time and then key, by global numbering over range partitions."""
    keys = [*([table.time_col] if table.time_col else []), *order, table.pkey]
    rows = table.df.select(*[F.col(quoted(k)) for k in dict.fromkeys(keys)])
    return range_numbered(rows, list(dict.fromkeys(keys))).select(F.col(quoted(table.pkey)).alias("old"), F.col("index").alias("new"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once, with their count."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def remap(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Replace a reference by its dense id; what the map does not have becomes null."""
    names = df.columns
    known = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    joined = df.join(known, F.col(quoted(column)) == F.col("_old"), "left")
    return joined.select(*[F.col("_new").alias(c) if c == column else F.col(quoted(c)) for c in names])


def rekey(db: RelDatabase, check: bool = True) -> tuple[RelDatabase, dict[str, DataFrame]]:
    """Dense keys for every table with one, and all references remapped; also the maps (old, new)."""
    maps: dict[str, DataFrame] = {}
    for name, t in db.tables.items():
        if t.pkey:
            if check and (twice := duplicate_keys(t.df, [t.pkey]).head(1)):
                raise ValueError(f"table {name}: key {twice[0][0]!r} is not unique")
            maps[name] = dense_ids(t)
    out = {}
    for name, t in db.tables.items():
        df = remap(t.df, t.pkey, maps[name]) if t.pkey else t.df
        for column, parent in t.fkeys.items():
            df = remap(df, column, maps[parent])
        out[name] = t.with_df(df)
    return RelDatabase(out), maps


def to_internal(ids: Sequence[Any] | DataFrame | str, mapping: DataFrame) -> DataFrame | str:
    """Outer ids to dense ids; unknown ones go with a warning; ``"all"`` passes; one scalar is an error."""
    if isinstance(ids, str) and ids == "all":
        return ids
    if isinstance(ids, (str, int, float)):
        raise TypeError("a list of ids is expected; wrap a single id in a list")
    if not isinstance(ids, DataFrame):
        kind = mapping.schema["old"].dataType
        ids = mapping.sparkSession.createDataFrame([(i,) for i in ids], f"old {kind.simpleString()}")
    asked = ids.toDF("old").distinct()
    if lost := asked.join(mapping, "old", "left_anti").count():
        warn(f"{lost} unknown ids are left out")
    return asked.join(mapping, "old").select("new")


def to_external(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    back = mapping.select(F.col("new").alias("old"), F.col("old").alias("new"))
    return remap(df, column, back)


def null_census(df: DataFrame) -> DataFrame:
    """One row: rows, and non-null values of every column (``nn_<column>``)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(quoted(c))).alias(f"nn_{c}") for c in df.columns])


def clean_columns(db: RelDatabase, name: str = "", leaking: Mapping[str, Mapping[str, Sequence[str]]] = LEAKING) -> RelDatabase:
    """Drop columns that are all null, named ``Unnamed: ...``, or known to leak; untouched tables stay the same object."""
    out = {}
    for table, t in db.tables.items():
        row = null_census(t.df).first()
        gone = {c for c in t.df.columns if c.startswith("Unnamed:") or c in leaking.get(name, {}).get(table, ())}
        if row["n_rows"]:
            gone |= {c for c in t.df.columns if row[f"nn_{c}"] == 0}
        gone -= {t.pkey, t.time_col, *t.fkeys}
        out[table] = t.with_df(t.df.drop(*[c for c in t.df.columns if c in gone])) if gone else t
    return RelDatabase(out)
