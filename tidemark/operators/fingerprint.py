"""Checksums that depend on values, names and kinds, but not on partitions; and identities from schemas."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.sources.schema import RelDatabase, TaskSpec


def column_checksums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: for each column the XOR of 60-bit hashes of (name, key, value) over all rows.

    The key ties a value to its row, so swapping two rows' values shows; XOR is associative, so partitions do not.
    """
    place = F.concat_ws("|", *[F.col(quoted(k)).cast("string") for k in keys])

    def one(name: str):
        c = F.col(quoted(name))
        value = F.coalesce(F.to_json(F.struct(c)) if df.schema[name].dataType.typeName() in ("array", "struct", "map") else c.cast("string"), F.lit("null"))
        digest = F.md5(F.concat_ws("|", F.lit(name), place, value).cast("binary"))
        return F.bit_xor(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).alias(name)

    return df.agg(*[one(c) for c in df.columns])


def table_checksum(df: DataFrame, keys: Sequence[str]) -> str:
    row = column_checksums(df, keys).first().asDict()
    return hashlib.blake2s(json.dumps([df.schema.jsonValue(), row], sort_keys=True).encode(), digest_size=8).hexdigest()


def database_checksums(db: RelDatabase) -> dict[str, str]:
    return {n: table_checksum(t.df, [t.pkey] if t.pkey else t.df.columns) for n, t in db.tables.items()}


def record_checksums(path: str | Path, sums: Mapping[str, str]) -> None:
    Path(path).write_text(json.dumps(dict(sums), indent=1, sort_keys=True))


def check_checksums(path: str | Path, sums: Mapping[str, str]) -> list[str]:
    """Names whose checksum is not what was recorded."""
    known = json.loads(Path(path).read_text())
    return sorted(k for k in {*known, *sums} if known.get(k) != sums.get(k))


def schema_fingerprint(db: RelDatabase) -> str:
    parts = {n: [t.df.schema.jsonValue(), t.pkey, dict(t.fkeys), t.time_col] for n, t in db.tables.items()}
    return hashlib.blake2s(json.dumps(parts, sort_keys=True).encode(), digest_size=8).hexdigest()


def task_fingerprint(task: TaskSpec) -> str:
    return hashlib.blake2s(json.dumps([str(v) for v in vars(task).values()]).encode(), digest_size=8).hexdigest()


def content_fingerprint(db: RelDatabase) -> str:
    """Schema and content of all tables; one pass over each."""
    return hashlib.blake2s(json.dumps([schema_fingerprint(db), database_checksums(db)], sort_keys=True).encode(), digest_size=8).hexdigest()
