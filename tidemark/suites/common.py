"""The local star schema as a relational database."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.sources.schema import DatabaseSpec, RelDatabase, TableSpec, read_database

TABLES = {
    "region": dict(pkey="r_regionkey"),
    "nation": dict(pkey="n_nationkey", fkeys={"n_regionkey": "region"}),
    "customer": dict(pkey="c_custkey", fkeys={"c_nationkey": "nation"}),
    "supplier": dict(pkey="s_suppkey", fkeys={"s_nationkey": "nation"}),
    "part": dict(pkey="p_partkey"),
    "orders": dict(pkey="o_orderkey", time_col="o_orderdate", fkeys={"o_custkey": "customer"}),
    "lineitem": dict(time_col="l_shipdate", fkeys={"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": dict(pkey="event_id", time_col="ts"),
}


def star(spark: SparkSession, sf_dir: str, *names: str, columns: dict[str, tuple[str, ...]] | None = None) -> RelDatabase:
    """The tables asked for; references to tables that are not asked for are left out."""
    specs = {}
    for n in names or TABLES:
        t = TABLES[n]
        fkeys = {c: p for c, p in t.get("fkeys", {}).items() if not names or p in names}
        specs[n] = TableSpec(f"{sf_dir}/{n}.parquet", t.get("pkey"), t.get("time_col"), fkeys, (columns or {}).get(n))
    return read_database(spark, DatabaseSpec("star", specs))
