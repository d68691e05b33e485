"""Multi-party perspective rotation of dialogues.

A dialogue is rendered once for every participant: that speaker's turns become ``assistant``, all others stay users with
their names, and the mask is one on what the assistant says and its end mark.  Turns of the role ``system`` are
instructions: they stay so in every perspective and are nobody's.  Turns follow (turn, role, text).  Long dialogues are cut
into parts of ``max_turns`` consecutive turns, so no row grows without bound; every participant of the dialogue gets every
part, with its own turns there or not.  The place of a turn comes from a global numbering, so a dialogue of any length is
spread over tasks until its parts are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, range_numbered, settle

#: The role whose turns are instructions and not a participant's.
SYSTEM = "system"


def rotate(
    conversations: DataFrame,
    max_turns: int = 128,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per (dialogue part, participant): conv_id, part, participant, rendered, spans, n_turns, n_masked_turns.

    ``spans`` are (start, end) code point ranges of ``rendered`` on which the mask is one: an assistant turn's text with
    its end mark.  ``<|`` in texts and names is written ``< |``, so no text can forge a mark.

    Nulls: a null text is empty; a null role is the participant ``unknown``; a null turn comes first; rows of a null
    dialogue are one dialogue.  Repeated rows are said twice.  A dialogue of system turns only has no participant and no
    rows, nor has an empty table; other columns are ignored.
    """
    safe = "replace({}, '<|', '< |')"
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    placed = range_numbered(rows, ["turn", "role", "text"], by=["conv_id"]).withColumn(
        "part", F.expr(f"index div {max_turns}")
    )
    placed = cut(placed)
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("index", "role", "text"))).alias("turns"))
    speakers = placed.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("participant")).distinct()
    each = parts.join(settle(speakers).side, F.col("conv_id").eqNullSafe(F.col("_conv")))
    name = safe.format("t.role")
    each = each.withColumn(
        "pieces",
        F.expr(
            f"""
            transform(turns, t -> named_struct(
              'head', CASE WHEN t.role = '{SYSTEM}' THEN '<|system|>\\n'
                           WHEN t.role = participant THEN '<|assistant|>\\n'
                           ELSE concat('<|user name=', {name}, '|>\\n') END,
              'body', concat({safe.format("t.text")}, '<|end|>\\n'),
              'own', t.role = participant))
            """
        ),
    )
    each = each.withColumn("rendered", F.expr("array_join(transform(pieces, p -> concat(p.head, p.body)), '')")).withColumn(
        "spans",
        F.expr(
            """
            filter(
              aggregate(
                pieces,
                named_struct('at', 0L, 'out', cast(array() as array<struct<start: bigint, end: bigint, own: boolean>>)),
                (acc, p) -> named_struct(
                  'at', acc.at + length(p.head) + length(p.body),
                  'out', concat(acc.out, array(named_struct(
                    'start', acc.at + length(p.head), 'end', acc.at + length(p.head) + length(p.body), 'own', p.own)))),
                acc -> acc.out),
              s -> s.own)
            """
        ),
    )
    return each.select(
        "conv_id",
        "part",
        "participant",
        "rendered",
        F.expr("transform(spans, s -> named_struct('start', s.start, 'end', s.end))").alias("spans"),
        F.size("turns").alias("n_turns"),
        F.size("spans").alias("n_masked_turns"),
    )
