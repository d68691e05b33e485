"""Pipeline stages: each applies one operator and returns documents with the columns they came with."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.llm.line_templates import drop_lines
from tidemark.llm.minhash_forest import near_duplicates
from tidemark.llm.pfair_mixing import mix_sources
from tidemark.llm.robust_outliers import keep_quality
from tidemark.llm.vector_packing import pack_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers.

    Few words alone are no fault here, so the least number of words is one: short texts are judged like others.  A null
    text, or one without words, goes; a null language or source is a value of its own.  Repeated rows (id and
    text) go or stay together.  No rows give no rows.
    """
    return keep_quality(docs, least_words=1)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; ``n_chars`` follows the text where lines went.

    Every row stays: null and empty texts as they are, repeated rows alike, and a text of recurring lines only is empty.
    """
    (count,) = fresh(docs, "_tm_dropped")
    out = drop_lines(docs, dropped_col=count)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates (five words, similarity 0.8).

    Rows without words or without an id have no duplicates and stay; repeated rows of the smallest id all stay.
    """
    (key,) = fresh(docs, "_tm_id")
    gone = near_duplicates(docs, width=5, percent=80).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the mixed order: files and rows in files follow the position.

    A null source is a source of its own, a null text has no bytes, and repeated rows stand together at the first one's
    place.  No rows give no rows.
    """
    key, crc, at, own = fresh(docs, "_tm_id", "_tm_crc", "_tm_at", "_tm_text")
    positions = (
        mix_sources(docs).groupBy("doc_id", "text_crc32").agg(F.min("position").alias(at))
        .select(F.col("doc_id").alias(key), F.col("text_crc32").alias(crc), at)
    )
    found = docs.withColumn(own, F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(crc))
    placed = found.join(positions, same)
    return placed.repartitionByRange(at).sortWithinPartitions(at).select(docs.columns)


def _laid_out(docs: DataFrame, name: str) -> DataFrame:
    """The documents with their place in the order in which they were written (file, then row), or else that of the frame."""
    try:
        numbered = docs.withColumns({f"{name}f": F.col("_metadata.file_name"), f"{name}r": F.col("_metadata.row_index")})
    except AnalysisException:  # no files, so no such column
        return docs.withColumn(name, F.monotonically_increasing_id())
    files = numbered.select(f"{name}f").distinct()
    files = files.withColumn(f"{name}k", F.row_number().over(Window.orderBy(f"{name}f")).cast("long"))
    return numbered.join(F.broadcast(files), f"{name}f").withColumn(name, F.expr(f"{name}k * 1099511627776 + {name}r")).drop(f"{name}f", f"{name}r", f"{name}k")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequence and offset; sequences are numbered along the mixed order.

    A null text has the end id only; every row is packed, repeated ones and those without an id too.
    """
    import public_tokenizers

    (at,) = fresh(docs, "_tm_place")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(_laid_out(docs, at), vocabulary, public_tokenizers.PATTERN, length=2048, order_col=at)
