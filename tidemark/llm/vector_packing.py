"""Packing token sequences by vector best-fit.

Documents become token ids plus an end id.  Pieces of exactly ``length`` tokens are sequences of their own; the rest are
dealt by hash into groups of about ``group_rows`` pieces, and each group is packed in memory, longest piece first.  A
bin has three residual capacities (tokens, documents, attention cost as the sum of squared lengths); a piece goes to the
open bin that can take it under every constraint with the smallest weighted norm of what is left (``rule="norm"``) or
the largest weighted dot product of demand and residual (``rule="dot"``).

With ``order_col`` the groups are consecutive ranges of that order instead, each packed in the same way, and sequences
are numbered along it, in a group by their earliest piece: a sequence is at most one group away from its pieces' places.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, range_numbered, small_batches


def encoder(vocabulary: str, pattern: str):
    """The byte-level BPE of a ``tokenizers`` file: its tokens, merges and added tokens, run by ``tiktoken``.

    ``pattern`` is what the file's byte-level pre-tokenizer splits texts by.  Files that do more than that (a normalizer,
    merges out of the order of ids, added tokens that are not matched as they stand) raise ValueError.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    # Byte-level files write each byte as a printable character: printable ones as they are, the rest from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
    ids = [file["model"]["vocab"][a + b] for a, b in merges]
    loose = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in file["added_tokens"])
    if loose or file["normalizer"] or file["pre_tokenizer"].get("add_prefix_space") or file["model"].get("dropout") or ids != sorted(ids):
        raise ValueError(f"{vocabulary} is more than merges and added tokens")
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all")


def _pieces(vocabulary: str, pattern: str, length: int, end_id: int):
    """(id, text, at) batches to one row a piece: id, piece, start, length, ids_crc32, at.  The first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        for batch in batches:
            out: list[tuple[int | None, int, int, int, int, int | None]] = []
            for key, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                begin, end = 0, len(ids) % length or length
                piece = 0
                while begin < len(ids):
                    out.append((key, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes()), at))
                    begin, end, piece = end, end + length, piece + 1
            if out:
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["id", "piece", "start", "length", "ids_crc32", "at"],
                )

    return run


def best_fit(
    lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must come in falling order."""
    full = np.array(capacity, float)
    scale = np.array(weights, float)
    left = np.zeros((3, 0))
    names = np.zeros(0, np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made, room = 0, 0
    least = lengths[-1] if len(lengths) else 0
    for k, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        at = -1
        if room:
            fits = np.flatnonzero((left[0, :room] >= n) & (left[1, :room] >= 1) & (left[2, :room] >= need[2]))
            if len(fits):
                after = (left[:, fits] - need[:, None]) / full[:, None]
                if rule == "norm":
                    at = fits[np.argmin(scale @ (after * after))]
                else:
                    at = fits[np.argmax((scale * need / full) @ (left[:, fits] / full[:, None]))]
        if at < 0:
            if room == left.shape[1]:
                left = np.concatenate((left, np.zeros((3, max(64, room)))), 1)
                names = np.concatenate((names, np.zeros(max(64, room), np.int64)))
            at, room = room, room + 1
            left[:, at], names[at] = full, made
            made += 1
        bins[k], offsets[k] = names[at], full[0] - left[0, at]
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1:  # nothing fits any more: the last open bin takes its place
            room -= 1
            left[:, at], names[at] = left[:, room], names[room]
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    length: int = 2048,
    end_id: int = 0,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001),
    rule: str = "norm",
    group_rows: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
    order_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``vocabulary`` and ``pattern`` are those of ``encoder``.  ``order_col`` is a whole-number column; sequence ids then rise
    along it, group after group.

    Without ``max_documents`` and ``max_attention`` those capacities bind no packing that fits by tokens.  A full-length
    piece is a sequence of its own and takes one document and its own attention cost, whatever the capacities.

    Nulls: a null text is empty and has the end id only; rows with null ids are packed like others.  Repeated rows are
    each packed.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(order_col) if order_col else F.lit(None)).cast("long").alias("at")
        ).mapInArrow(
            _pieces(vocabulary, pattern, length, end_id),
            "id long, piece int, start long, length long, ids_crc32 long, at long",
        )
    )
    capacity = (float(length), float(max_documents or length), float(max_attention or float(length) ** 2))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if order_col:

        def pack_range(group: pa.Table) -> pa.Table:
            group = group.sort_by([("length", "descending"), ("index", "ascending")])
            sizes, index = group["length"].to_numpy(), group["index"].to_numpy()
            full = int((sizes == length).sum())
            bins, offsets = best_fit(sizes[full:], capacity, weights, rule)
            bins, offsets = np.concatenate((np.arange(full), full + bins)), np.concatenate((np.zeros(full, np.int64), offsets))
            earliest = np.full(bins.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(earliest, bins, index)
            along = np.empty(len(earliest), np.int64)
            along[np.argsort(earliest)] = np.arange(len(earliest))
            group = group.append_column("sequence_id", pa.array((group["g"].to_numpy() << 32) + along[bins]))
            return group.append_column("offset", pa.array(offsets)).drop_columns(["g", "index"])

        ranged = range_numbered(pieces, ["at", "id", "piece", "ids_crc32"]).drop("at").withColumn("g", F.expr(f"index div {group_rows}"))
        return ranged.groupBy("g").applyInArrow(pack_range, schema).withColumnRenamed("id", "doc_id")

    pieces = pieces.drop("at")
    groups = -(-pieces.where(F.col("length") < length).count() // group_rows) or 1

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(group["length"].to_numpy(), capacity, weights, rule)
        group = group.append_column("sequence_id", pa.array((group["g"].to_numpy() << 32) + bins))
        return group.append_column("offset", pa.array(offsets)).drop_columns(["g"])

    numbered = pieces.withColumn("_at", F.monotonically_increasing_id())
    rest = numbered.where(F.col("length") < length).select(
        "id", "piece", "start", "length", "ids_crc32", F.expr(f"pmod(xxhash64(id, piece, _at), {groups})").alias("g")
    )
    packed = rest.groupBy("g").applyInArrow(pack, schema)
    whole = numbered.where(F.col("length") == length).select(
        "id", "piece", "start", "length", "ids_crc32", (-1 - F.col("_at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole).withColumnRenamed("id", "doc_id")
