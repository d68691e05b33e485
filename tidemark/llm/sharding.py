"""Contiguous shards of equal bytes from global prefix sums.

Law ``bytes``: along the order of (doc_id, checksum, size) every row gets the bytes before it, found from per-partition
totals, and a shard ends where the running bytes pass an equal target.  A shard differs from its target by no more than
the longest row at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import range_numbered


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    Nulls: a null text has size 1 and the checksum of no bytes; null ids come first and are placed like others.
    Repeated rows are each placed.  An empty table gives no rows; other columns are ignored.  Equal rows tie, and any of
    them may take either place, as they cannot be told apart.
    """
    blank = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(blank) + 1).cast("long").alias("size"),
        F.crc32(F.encode(blank, "UTF-8")).alias("text_crc32"),
    )
    placed = range_numbered(rows, ["doc_id", "text_crc32", "size"], sums=["size"])
    total = placed.agg(F.sum("size").alias("_total"))
    # A row belongs to the target in which its middle byte lies; doubled to stay with whole numbers.
    cutting = placed.crossJoin(F.broadcast(total)).withColumn(
        "shard",
        F.expr(f"int(least({shards - 1}, ((2 * size_before + size) * {shards}) div (2 * _total)))"),
    )
    firsts = cutting.groupBy("shard").agg(F.min("index").alias("_first"))
    return cutting.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("index") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
