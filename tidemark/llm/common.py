"""Session, checkpoint, numbering and join helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.numbering import cut, range_numbered

__all__ = ["BROADCAST_BYTES", "Settled", "cut", "documents", "fresh", "join_by_size", "range_numbered", "settle", "small_batches"]

#: Measured bytes that may be broadcast; a hashed relation takes several times as much.
BROADCAST_BYTES = 4 << 20

_FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "date": 4, "float": 4}


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound what one Arrow batch holds, for texts that may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has such a column already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Settled(NamedTuple):
    """A checkpointed frame with what was counted while it was written."""

    frame: DataFrame
    rows: int
    bytes: int
    seen: dict

    @property
    def side(self) -> DataFrame:
        """The frame as a side of a join: broadcast if its measured bytes allow it."""
        return F.broadcast(self.frame) if self.bytes <= BROADCAST_BYTES else self.frame


def settle(df: DataFrame, **metrics: Column) -> Settled:
    """Checkpoint a frame; its rows, its bytes and further aggregates are taken in the same job."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        value = F.col("`" + name.replace("`", "``") + "`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(value), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.greatest(F.size(value), F.lit(0))
        else:
            size = size + _FIXED.get(kind, 8)
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("_rows"), F.sum(size.cast("long")).alias("_bytes"), *[m.alias(n) for n, m in metrics.items()]))
    got = seen.get
    return Settled(out, got["_rows"], got["_bytes"] or 0, got)


def join_by_size(left: DataFrame, keys: DataFrame, on: str | Sequence[str] | Column, how: str) -> DataFrame:
    """Join with a side that grows slower than the corpus: it is settled, and broadcast only if its measured bytes allow it.

    Sides with a row per document are joined plainly, so that plans are alike at every size.
    """
    return left.join(settle(keys).side, on, how)
