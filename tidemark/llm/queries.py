"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.collision_projections import near_vectors
from tidemark.llm.common import documents
from tidemark.llm.line_templates import drop_lines
from tidemark.llm.longest_previous import remove_repeats
from tidemark.llm.minhash_forest import near_duplicates
from tidemark.llm.perspectives import rotate
from tidemark.llm.pfair_mixing import mix_sources
from tidemark.llm.robust_outliers import quality
from tidemark.llm.sharding import shard_by_bytes
from tidemark.llm.url_model import judge_urls
from tidemark.llm.vector_packing import pack_documents

#: Host and path rules of the URL query.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op3_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(documents(spark, sf_dir, "embeddings"), least=0.95)


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines dropped, and size and CRC-32 of what is left."""
    left = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return drop_lines(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("_tm_dropped").cast("long").alias("n_dropped"),
        F.octet_length(left).cast("long").alias("n_bytes_left"),
        F.crc32(left).alias("left_crc32"),
    )


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), shards=8)


def op6_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(documents(spark, sf_dir, "pages"), URL_RULES)


def op7_longest_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), length=100)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, length=2048)


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(documents(spark, sf_dir, "conversations")).select(
        "conv_id",
        "part",
        "participant",
        "rendered",
        F.expr("array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')").alias("masked"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.col("n_masked_turns").cast("long").alias("n_masked_turns"),
    )


_PERSPECTIVES_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS LAST, text) - 1 AS place
  FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
m AS (
  SELECT t.conv_id, t.place // 128 AS part, s.participant, t.place, t.role = s.participant AS own,
         CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10) WHEN t.role = s.participant THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(t.role, '<|', '< |') || '|>' || chr(10) END AS head,
         replace(t.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), e AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, participant ORDER BY place) AS stop FROM m
)
SELECT conv_id, part::BIGINT AS part, participant, string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY place), '') AS masked,
       count(*)::BIGINT AS n_turns, (count(*) FILTER (own))::BIGINT AS n_masked_turns
FROM e GROUP BY conv_id, part, participant
"""

_SHARDS_SQL = """
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) ORDER BY i) AS c
  FROM range(256) r(i)
), hexes AS (
  SELECT list(i ORDER BY h) AS v FROM (SELECT i, printf('%02X', i) AS h FROM range(256) r(i))
), rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17),
           lambda a, b: xor(a // 256, c[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc
), placed AS (
  SELECT *, coalesce(sum(size) OVER w, 0) AS before, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS place,
         sum(size) OVER () AS total
  FROM rows WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cutting AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cutting
"""


_LINKS_SQL = """
linked AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN linked l ON l.a = r.other)
"""

_FOREST_SQL = (
    """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), """
    + _LINKS_SQL
    + """
SELECT nodes.id AS doc_id, n::BIGINT AS n_shingles, min(other) AS component_id, nodes.id = min(other) AS kept
FROM nodes JOIN reach ON reach.id = nodes.id GROUP BY nodes.id, n
"""
)

_VECTORS_SQL = (
    """
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT id, v FROM nodes WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id < y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95), """
    + _LINKS_SQL
    + """, degree AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT nodes.id AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, nodes.id = min(other) AS kept
FROM nodes JOIN reach ON reach.id = nodes.id LEFT JOIN degree ON degree.a = nodes.id GROUP BY nodes.id
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_minhash_forest,
            op2_robust_outliers,
            op3_collision_projections,
            op4_line_templates,
            op5_byte_shards,
            op6_url_model,
            op7_longest_previous,
            op8_vector_packing,
            op9_pfair_mixing,
            op10_perspectives,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Estimates, templates, tokens, models and byte strings have no SQL here: tests hold those against brute force."""
    return {
        "op1_minhash_forest": _FOREST_SQL,
        "op3_collision_projections": _VECTORS_SQL,
        "op5_byte_shards": _SHARDS_SQL,
        "op10_perspectives": _PERSPECTIVES_SQL,
    }
