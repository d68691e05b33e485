"""Proportionate-fair interleaving of source blocks.

Every source has a target weight; weights are whole numbers of slots in a period.  Block ``k`` of a source with ``c`` of
the ``M`` slots is released at ``floor(k * M / c)`` and due at ``ceil((k + 1) * M / c)``.  In each slot the released
block with the earliest deadline runs.  A source has then, after any number of slots, less than one block more or less
than its weight asks for.  The schedule repeats after a period, so it is found once, by a fold inside one SQL expression
over the period, and joined to the blocks.

A block is ``block_bytes`` of a source's documents along its own order; a document longer than a block takes as many
blocks as it fills.  No document is dropped: a source that has no more blocks leaves its slots empty and the others go
on, so the law holds up to the slot in which the first source runs out (column ``on_target``).
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, range_numbered, settle

#: Sources that are scheduled one by one.
MAX_SOURCES = 1024

#: Slots that a period may have before weights are rounded.
MAX_PERIOD = 8192


def _stream(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def schedule(slots: DataFrame, period: int) -> DataFrame:
    """Streams with ``slots`` (sum = period) to rows (stream, nth, slot): the slot of each stream's n-th block.

    The fold goes by runs of slots, so that appending to what is found copies little.
    """
    one = slots.agg(F.sort_array(F.collect_list(F.struct("stream", "slots"))).alias("_c"))
    step = f"""
      (acc, t) -> transform(
        array(
          array_min(
            transform(
              filter(
                transform(_c, (x, i) -> named_struct('slots', x.slots, 'k', acc.taken[i], 'i', i)),
                y -> y.k < y.slots AND (bigint(y.k) * {period}) div y.slots <= t
              ),
              y -> named_struct('due', ((bigint(y.k) + 1) * {period} + y.slots - 1) div y.slots, 'i', y.i)
            )
          ).i
        ),
        p -> named_struct(
          'taken', transform(acc.taken, (n, i) -> n + CASE WHEN i = p THEN 1 ELSE 0 END),
          'out', concat(acc.out, array(p))
        )
      )[0]
    """
    fold = f"""
      aggregate(
        sequence(0, {period - 1}, 64),
        named_struct('taken', transform(_c, x -> 0), 'out', cast(array() as array<int>)),
        (run, first) -> aggregate(
          sequence(first, least(first + 63, {period - 1})),
          named_struct('taken', run.taken, 'out', cast(array() as array<int>)),
          {step},
          part -> named_struct('taken', part.taken, 'out', concat(run.out, part.out))
        ),
        run -> run.out
      )
    """
    run = one.select("_c", F.posexplode(F.expr(fold)).alias("slot", "_p"))
    run = run.select(F.expr("get(_c, _p).stream").alias("stream"), "slot").where("stream IS NOT NULL")
    # Slots of one stream, at most a period, are numbered.
    listed = run.groupBy("stream").agg(F.sort_array(F.collect_list("slot")).alias("_s"))
    return listed.select("stream", F.posexplode("_s").alias("nth", "slot"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    temperature: float = 0.7,
    block_bytes: int = 65536,
    period: int = 720,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, text_crc32, size, stream, stream_weight, block, slot, position, on_target.

    ``weights`` gives target shares by source, for at most ``MAX_SOURCES`` sources, none of them negative and one at least
    positive.  Sources without a positive weight have no slots: their documents follow behind all others, with a null
    slot.  Without ``weights`` shares follow bytes ** temperature; sources beyond the ``MAX_SOURCES`` - 1 largest then
    share one stream with the sum of their weights, in hash order.  ``position`` is the place in the mixed order, gapless
    from 0.

    Weights are rounded to whole slots, one at least, of about ``period``, which grows up to ``MAX_PERIOD`` until the
    least weight has a slot; given weights that ask for more raise ValueError.  ``stream_weight`` is the rounded weight.

    Nulls: a null source is a source of its own; a null text has no bytes; null ids come first in their source.  Rows
    that are equal in all of these tie in any order.  An empty table gives no rows; other columns are ignored.
    """
    blank = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.crc32(F.encode(blank, "UTF-8")).alias("text_crc32"),
        (F.octet_length(blank) + 1).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("stream"),
    ).withColumn("_along", F.col("doc_id"))
    sized = rows.groupBy("stream").agg(F.sum("size").alias("bytes"))
    if weights is None:
        sized = settle(sized.select("stream", "bytes", F.pow(F.col("bytes").cast("double"), F.lit(temperature)).alias("_w")), total=F.sum("_w"), least=F.min("_w"))
        streams = sized
        if sized.rows > MAX_SOURCES:
            top = settle(sized.frame.orderBy(F.desc("_w"), "stream").limit(MAX_SOURCES - 1), total=F.sum("_w"), least=F.min("_w"))
            rest = sized.seen["total"] - top.seen["total"]
            streams = settle(top.frame.unionByName(top.frame.agg(F.lit("rest").alias("stream"), F.lit(0).cast("long").alias("bytes"), F.lit(rest).alias("_w"))), least=F.min("_w"))
            rows = rows.join(F.broadcast(top.frame.select("stream", F.lit(True).alias("_own"))), "stream", "left").select(
                "doc_id", "text_crc32", "size", F.when(F.col("_own"), F.col("stream")).otherwise("rest").alias("stream"),
                F.when(F.col("_own"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text_crc32")).alias("_along"),
            )
        total = sized.seen["total"] or 1.0
    else:
        asked = {_stream(k): float(v) for k, v in weights.items()}
        if len(asked) > MAX_SOURCES or not all(math.isfinite(v) and v >= 0 for v in asked.values()) or not any(asked.values()):
            raise ValueError(f"weights: at most {MAX_SOURCES}, finite, not negative, and one positive")
        given = F.create_map(*[F.lit(x) for k, v in asked.items() for x in (k, v)])
        streams = settle(sized.withColumn("_w", given[F.col("stream")]).where("_w > 0"), total=F.sum("_w"), least=F.min("_w"))
        total = streams.seen["total"] or 1.0
    least = (streams.seen["least"] or total) / total
    if weights is not None and math.ceil(1 / least - 1e-9) > MAX_PERIOD:
        raise ValueError(f"weights: the least is under one of {MAX_PERIOD} slots")
    about = min(max(period, math.ceil(1 / least - 1e-9)), MAX_PERIOD)
    slots = settle(
        streams.frame.select("stream", F.greatest(F.lit(1), F.round(F.col("_w") * (about / total))).cast("int").alias("slots")), period=F.sum("slots")
    )
    period = slots.seen["period"] or 1
    plan = settle(schedule(slots.frame, period).select("stream", "nth", F.col("slot").alias("_at"))).frame

    placed = range_numbered(rows, ["_along", "doc_id", "text_crc32", "size"], sums=["size"], by=["stream"])
    placed = cut(placed.select("doc_id", "text_crc32", "size", "stream", "size_before", F.expr(f"size_before div {block_bytes}").alias("block")))
    timed = placed.join(F.broadcast(slots.frame), "stream", "left").withColumn("nth", F.expr("int(block % slots)"))
    timed = timed.join(F.broadcast(plan), ["stream", "nth"], "left").withColumn("slot", F.expr(f"(block div slots) * {period} + _at"))
    # The first slot that a source cannot fill any more: its last block's successor.
    ends = (
        placed.groupBy("stream").agg(F.max("block").alias("_last")).join(F.broadcast(slots.frame), "stream")
        .withColumn("nth", F.expr("int((_last + 1) % slots)"))
        .join(F.broadcast(plan), ["stream", "nth"])
        .agg(F.min(F.expr(f"((_last + 1) div slots) * {period} + _at")).alias("_horizon"))
    )
    ordered = range_numbered(
        timed.select(
            "doc_id", "text_crc32", "size", "stream", (F.coalesce("slots", F.lit(0)) / period).alias("stream_weight"), "block", "slot",
            F.coalesce("slot", F.lit((1 << 63) - 1)).alias("_when"), F.when(F.col("slot").isNull(), F.col("stream")).alias("_late"),
            F.col("size_before").alias("_before"),
        ),
        ["_when", "_late", "_before", "doc_id", "text_crc32"],
    )
    return ordered.crossJoin(F.broadcast(ends)).select(
        "doc_id", "text_crc32", "size", "stream", "stream_weight", "block", "slot",
        F.col("index").alias("position"), F.coalesce(F.col("slot") < F.col("_horizon"), F.lit(False)).alias("on_target"),
    )
