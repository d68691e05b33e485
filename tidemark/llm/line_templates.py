"""Line dedup by a fixed-depth tree of line templates.

A line goes down the tree by its number of tokens and its first ``lead`` tokens (tokens with a digit are the wildcard).
In a leaf, a token that stands at its place in ``least_docs`` documents or more can be constant and all others are variable
fields.  How many documents make it constant has no one answer, as values of a field become frequent in a large leaf, so
all steps count, each ``STEP`` times the one before: at a step the tokens with as many documents are constant, and a line
belongs to the template that they make if they are at least ``share`` of its tokens.  A line can thus be of several
templates, one a step at most, and is dropped if any of them recurs.  That is the same whatever the order of lines, so all of it is counting: keys are aggregated before they are shuffled, and no
leaf is gathered.  Every token of a line is a place, however long the line is.

A template recurs if lines of it stand in ``least_docs`` documents.  A document most of whose words lie in recurring
lines is a copy of others; copies are counted out and the documents of each template are counted again, so that a text
that was copied as a whole keeps its own lines, and document-level dedup decides on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, join_by_size, settle, small_batches
from tidemark.llm.text import chunks, mix, spans, words

#: Places that one batch of exploded lines holds at most.
CELLS = 1 << 18

#: Growth of the number of documents that makes a token constant, from step to step.
STEP = 2


def _lines(lead: int, least_tokens: int, places: bool = False):
    """(id, key, text) to one row a line with words: id, key, n_words of the text, line number, tokens, leaf, line.

    With ``places`` a row is leaf, line and the hashes of the line's tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, buf, bounds in chunks(batch.column("text")):
                starts, ends, at = words(buf, bounds)
                if not len(starts):
                    continue
                hashed = spans(buf, starts, ends)
                digits = np.concatenate(([0], np.cumsum((buf >= 48) & (buf <= 57))))
                hashed[digits[ends] > digits[starts]] = np.uint64(1)
                feeds = np.flatnonzero(buf == 10)
                owner = np.repeat(np.arange(last - first), np.diff(at))
                line = np.searchsorted(feeds, starts)
                new = np.ones(len(starts), bool)
                new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                stop = np.concatenate((begin[1:], [len(starts)]))
                size = stop - begin
                doc = owner[begin]
                number = line[begin] - np.searchsorted(feeds, bounds[:-1])[doc]
                ok = size >= least_tokens
                begin, stop, size, doc, number = (x[ok] for x in (begin, stop, size, doc, number))
                if not len(begin):
                    continue
                whole = spans(hashed.view(np.uint8), 8 * begin, 8 * stop)
                leaf = size.astype(np.uint64)
                for k in range(lead):
                    leaf = mix(leaf * np.uint64(0x9E3779B97F4A7C15) + np.where(size > k, hashed[np.minimum(begin + k, stop - 1)], np.uint64(0)))
                if places:
                    offsets = np.concatenate(([0], np.cumsum(size)))
                    flat = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
                    cells = hashed[flat].astype("<u8")
                    packed = pa.Array.from_buffers(
                        pa.binary(), len(size), [None, pa.py_buffer((offsets * 8).astype(np.int32).tobytes()), pa.py_buffer(cells.tobytes())]
                    )
                    yield pa.record_batch(
                        [pa.array(leaf.view(np.int64)), pa.array(whole.view(np.int64)), packed], names=["leaf", "line", "places"]
                    )
                    continue
                take = pa.array(doc + first)
                yield pa.record_batch(
                    [
                        batch.column("id").take(take),
                        batch.column("key").take(take),
                        pa.array(np.diff(at)[doc]),
                        pa.array(number.astype(np.int32)),
                        pa.array(size),
                        pa.array(leaf.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                    ],
                    names=["id", "key", "n_words", "number", "tokens", "leaf", "line"],
                )

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the tokens of a line (last column) to one row a place: the other columns, place, token."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        offsets = np.concatenate(([0], np.cumsum([len(x) // 8 for x in texts], dtype=np.int64)))
        tokens = np.frombuffer(b"".join(texts), "<i8")
        names = batch.schema.names[:-1]
        for low in range(0, len(tokens), CELLS):
            at = np.arange(low, min(low + CELLS, len(tokens)))
            row = np.searchsorted(offsets, at, "right") - 1
            take = pa.array(row)
            yield pa.record_batch(
                [*[batch.column(n).take(take) for n in names], pa.array((at - offsets[row]).astype(np.int32)), pa.array(tokens[at])],
                names=[*names, "place", "token"],
            )


def recurring_lines(
    docs: DataFrame,
    least_docs: int = 8,
    least_tokens: int = 4,
    lead: int = 3,
    share: float = 0.6,
    copied: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per line to drop: id, key (hash of the text), number (of the line, from 0), template."""
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")
    )
    lines = cut(
        texts.mapInArrow(
            _lines(lead, least_tokens),
            "id long, key long, n_words long, number int, tokens long, leaf long, line long",
        )
    )
    # Each document's distinct lines of each leaf: their number, and one of them that stands for the document.
    mine = Window.partitionBy("leaf", "id", "key")
    once = cut(
        lines.select("leaf", "line", "id", "key", "tokens").repartition("leaf", "id", "key").distinct()
        .withColumn("several", F.count(F.lit(1)).over(mine) > 1).withColumn("first", F.row_number().over(mine.orderBy("line")) == 1)
    )
    leaves = settle(once.where("first").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least_docs}").select("leaf")).side
    once = once.join(leaves, "leaf", "left_semi")
    distinct = once.groupBy("leaf", "line").agg(F.count_if(~F.col("several")).alias("docs"), F.first("tokens").alias("places"))
    # Tokens are found anew for lines of these leaves only: those of all lines are about as large as the texts.
    shown = texts.mapInArrow(_lines(lead, least_tokens, places=True), "leaf long, line long, places binary")
    shown = cut(shown.join(leaves, "leaf", "left_semi").groupBy("leaf", "line").agg(F.first("places").alias("tokens")))
    cells = cut(
        distinct.join(shown, ["leaf", "line"]).select("leaf", "line", "docs", "places", "tokens")
        .mapInArrow(_exploded, "leaf long, line long, docs long, places long, place int, token long")
    )
    # Documents with one line in a leaf are counted by line; those with several, each token once.
    repeated = once.where("several").drop("tokens").join(shown, ["leaf", "line"]).select("leaf", "id", "key", "tokens")
    repeated = repeated.mapInArrow(_exploded, "leaf long, id long, key long, place int, token long").distinct()
    counted = cells.select("leaf", "place", "token", "docs").unionByName(repeated.select("leaf", "place", "token", F.lit(1).cast("long").alias("docs")))
    constant = (
        counted.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(f"n >= {least_docs}")
        .select("leaf", "place", "token", F.expr(f"int(floor(log({STEP}, n / {least_docs})))").alias("step"))
    )
    held = (
        join_by_size(cells, constant, ["leaf", "place", "token"], "inner")
        .groupBy("leaf", "line", "places", "step")
        # An order-free digest of the constants; two moduli keep whole numbers from overflowing.
        .agg(
            F.count(F.lit(1)).alias("constants"),
            F.sum(F.expr("pmod(xxhash64(place, token), 1000000007)")).alias("t1"),
            F.bit_xor(F.expr("xxhash64(token, place, 1)")).alias("t2"),
        )
    )
    # Constants of a step are those of the later steps too: totals over a line's steps, of which there are few.
    later = Window.partitionBy("leaf", "line").orderBy(F.desc("step"))
    held = held.select("leaf", "line", "places", *[F.sum(c).over(later).alias(c) for c in ("constants", "t1")], F.bit_xor("t2").over(later).alias("t2"))
    members = (
        held.where(F.col("constants") >= share * F.col("places"))
        .select("leaf", "line", F.expr("xxhash64(leaf, t1, t2)").alias("template"))
    )
    placed = cut(join_by_size(lines, members, ["leaf", "line"], "inner"))

    def recurring(rows: DataFrame) -> DataFrame:
        return (
            rows.select("template", "id", "key").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n"))
            .where(f"n >= {least_docs}").select("template")
        )

    often = join_by_size(placed, recurring(placed), "template", "left_semi")
    copies = settle(
        often.dropDuplicates(["id", "key", "number"]).groupBy("id", "key").agg(F.sum("tokens").alias("in"), F.first("n_words").alias("n_words"))
        .where(F.col("in") > copied * F.col("n_words")).select(F.col("id").alias("c_id"), F.col("key").alias("c_key"))
    )
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key"))
    own = placed.join(copies.side, same, "left_anti")
    drops = join_by_size(placed, recurring(own), "template", "left_semi")
    return drops.groupBy("id", "key", "number").agg(F.min("template").alias("template"))


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str = "_tm_dropped", **options
) -> DataFrame:
    """The documents without the lines of recurring templates; all columns stay, and ``dropped_col`` counts lines.

    Nulls: a null text stays null; null ids are ids like others.  Repeated rows of one id and text are one document when
    documents are counted, and each loses the same lines.  A text of recurring lines only becomes empty.  Texts without
    such lines are unchanged to the byte.  An empty table gives no rows.
    """
    key, crc, lost, own = fresh(docs, "_tm_id", "_tm_key", "_tm_drop", "_tm_text")
    drops = (
        recurring_lines(docs, id_col=id_col, text_col=text_col, **options)
        .groupBy("id", "key").agg(F.collect_set("number").alias(lost))
        .select(F.col("id").alias(key), F.col("key").alias(crc), lost)
    )
    found = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(crc))
    both = found.join(drops, same, "left")
    name = "`" + text_col.replace("`", "``") + "`"
    cleaned = F.expr(
        f"array_join(transform(filter(transform(split({name}, '\\n', -1), (x, i) -> named_struct('x', x, 'i', i)), "
        f"s -> NOT array_contains({lost}, s.i)), s -> s.x), '\\n')"
    )
    return both.select(
        *[F.when(F.col(lost).isNotNull(), cleaned).otherwise(F.col(name)).alias(c) if c == text_col else both[c] for c in docs.columns],
        F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).alias(dropped_col),
    )
