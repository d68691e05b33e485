"""Exact substring dedup by longest previous factors.

A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller document id, or earlier in the same
document.  That is where the longest previous factor of a start is ``length`` or more.

Every string of ``length`` bytes is owned by one anchor inside it, the least hash of its ``gram``-byte windows (leftmost
at ties).  Equal strings have equal anchors at equal places, so an anchor's hash brings all occurrences of a string
together.  Consecutive starts with one anchor are a run; its bytes are its context.

1. Runs are dealt by anchor hash, those of the most common anchors by context too.  Runs whose anchor is found once have
   no match.  A run whose whole context (by a 96-bit hash of its bytes) stands earlier has all of its starts matched, and
   goes on as an interval only.
2. What is left, the first run of each different context of a repeated anchor, is gathered into buckets of bounded size.
   There the starts are put into suffix order (to ``length`` bytes, ties by position): a start whose predecessor in that
   order shares all bytes has an earlier match, its previous smaller position.
3. Common anchors, and those with more than ``large`` different contexts, are not gathered: 128-bit hashes of their strings find their first
   occurrence by aggregation.

Intervals are merged per document and cut out of its bytes.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, cut, join_by_size, small_batches
from tidemark.llm.text import chunks, mix, windows

_PLACE = 0xFFFFFF  # places in a chunk's low bits; a chunk over 16 MB uses more of them


def owners(buf: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, first start in the chunk, number of starts, anchor hash."""
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    width = length - gram + 1
    hashed = windows(buf, gram)
    starts = np.arange(len(hashed))
    low = _PLACE
    while low < n:
        low = low << 1 | 1
    key = (hashed & np.uint64(~low & (1 << 64) - 1)) | starts.astype(np.uint64)
    m = len(key) - width + 1
    padded = np.concatenate((key, np.full(-len(key) % width, (1 << 64) - 1, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.flatnonzero(text[:m] == text[length - 1 : length - 1 + m])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchor = (least[whole] & np.uint64(low)).astype(np.int64)
    new = np.ones(len(whole), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(whole)])))
    return text[whole[first]], whole[first], count, hashed[anchor[first]]


def _runs(length: int, gram: int):
    """(id, text) to one row a run: id, start, 2 * count of starts + done, anchor hash, 96-bit context hash (c1, c2).

    What repeats inside a batch is settled there: of runs with equal anchor and context only the earliest goes on, and
    the others, whose starts are all matched, leave as merged intervals (``done``).  Periodic texts and common passages
    so bring few rows of one anchor to the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            held: list[tuple[np.ndarray, ...]] = []
            for first, _, buf, bounds in chunks(batch.column(1)):
                text, start, count, anchor = owners(buf, bounds, length, gram)
                raw = memoryview(np.ascontiguousarray(buf))
                ends = (start + count - 1 + length).tolist()
                context = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), ends, strict=True)]), "<i8").reshape(-1, 2)
                held.append((ids[text + first], start - bounds[text], count, anchor.view(np.int64), context[:, 0], context[:, 1].astype(np.int32)))
            if not held or not sum(len(x[0]) for x in held):
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort((columns[1], columns[0], columns[5], columns[4]))
            key, start, count, anchor, c1, c2 = (x[order] for x in columns)
            new = np.ones(len(key), bool)
            new[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            done = (key != key[head]) | (start != start[head])
            k, lo, hi = _touching(key[done], start[done], start[done] + count[done] - 1 + length)
            own = mix(k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)).view(np.int64)
            n = int((~done).sum())
            yield pa.record_batch(
                [
                    pa.array(np.concatenate((key[~done], k))),
                    pa.array(np.concatenate((start[~done], lo))),
                    pa.array(2 * np.concatenate((count[~done], hi - lo - length + 1)) + (np.arange(n + len(k)) >= n)),
                    *[pa.array(np.concatenate((x[~done], own.astype(x.dtype)))) for x in (anchor, c1, c2)],
                ],
                names=["id", "start", "counted", "anchor", "c1", "c2"],
            )

    return run


def _touching(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each key, with those that touch or overlap made one."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    at = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    far = int(hi.max()) + 1  # keys are laid one after the other, so one running maximum serves all
    reach = np.maximum.accumulate(hi + at * far)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] + at[1:] * far > reach[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(key)])) - 1
    return key[first], lo[first], reach[last] - at[last] * far


def _contexts(length: int):
    """(id, text, runs) to one row a run with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, runs in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("runs"), strict=True):
                raw = (text.as_py() or "").encode()
                for r in runs.as_py():
                    piece = raw[r["start"] : r["start"] + r["count"] - 1 + length]
                    if len(piece) == r["count"] - 1 + length:  # not so where rows of one id have other texts
                        out.append((key, r["start"], r["anchor"], r["many"], piece))
            if out:
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)],
                    names=["id", "start", "anchor", "many", "bytes"],
                )

    return run


def suffix_runs(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, and the run of equal ones each is in.

    Big-endian words of eight bytes split runs further and further; only what is still tied is sorted again.
    """
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))
    for at in range(0, length, 8):
        if not len(tied):
            break
        held = min(8, length - at)
        word = np.zeros(len(tied), np.uint64)
        here = starts[order[tied]] + at
        for k in range(held):
            word |= padded[here + k].astype(np.uint64) << np.uint64(8 * (7 - k))
        by = np.lexsort((word, group[tied]))
        order[tied] = order[tied][by]
        g, word = group[tied][by], word[by]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (word[1:] != word[:-1])
        # Groups are numbered by their first place in the order, so they stay unique and sorted.
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        alone = new & np.concatenate((new[1:], [True]))
        tied = tied[~alone]
    return order, group


def _factors(length: int):
    """One bucket of contexts to matched intervals: id, lo, hi."""

    def run(rows: pa.Table) -> pa.Table:
        pieces = rows["bytes"].to_pylist()
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.concatenate(([0], np.cumsum(size)))[:-1]
        count = size - length + 1
        total = np.concatenate(([0], np.cumsum(count)))
        owner = np.repeat(np.arange(len(pieces)), count)
        inside = np.arange(total[-1]) - total[:-1][owner]
        doc = rows["id"].to_numpy()[owner]
        place = rows["start"].to_numpy()[owner] + inside
        # Starts in the order of positions, so that the stable sort breaks ties by position.
        by = np.lexsort((place, doc))
        order, group = suffix_runs(raw, (at[owner] + inside)[by], length)
        ranked = by[order]
        head = ranked[group]  # the earliest of the run stands at its head
        earlier = (doc[head] < doc[ranked]) | ((doc[head] == doc[ranked]) & (place[head] < place[ranked]))
        matched = np.zeros(len(ranked), bool)
        matched[ranked] = earlier
        return _merge(doc, owner, place, matched, length)

    return run


def _merge(doc: np.ndarray, owner: np.ndarray, place: np.ndarray, matched: np.ndarray, length: int) -> pa.Table:
    begin = matched.copy()
    begin[1:] &= ~(matched[:-1] & (owner[1:] == owner[:-1]))
    stop = matched.copy()
    stop[:-1] &= ~(matched[1:] & (owner[1:] == owner[:-1]))
    return pa.table({"id": doc[begin], "lo": place[begin], "hi": place[stop] + length})


def _strings(length: int):
    """Contexts to one row a start: id, start, two hashes of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, piece in zip(*(batch.column(c).to_pylist() for c in ("id", "start", "bytes")), strict=True):
                raw = np.frombuffer(piece, np.uint8)
                one, two = windows(raw, length), windows(raw, length, 1)
                n = np.arange(len(one))
                yield pa.record_batch(
                    [pa.array(np.full(len(n), key)), pa.array(n + start), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["id", "start", "s1", "s2"],
                )

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, merged intervals) to id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes."""
    for batch in batches:
        out: list[tuple] = []
        for key, text, cuts in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("cuts").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            left, at, gone, parts = [], 0, 0, 0
            for c in cuts or ():
                lo, hi = min(c["lo"], len(raw)), min(c["hi"], len(raw))
                if hi > lo:
                    left.append(raw[at:lo])
                    at, gone, parts = hi, gone + hi - lo, parts + 1
            left.append(raw[at:])
            out.append((key, len(raw), gone, parts, hashlib.sha256(b"".join(left)).hexdigest()))
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)] if out else [pa.array([], t) for t in (pa.int64(),) * 4 + (pa.string(),)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _released(df: DataFrame) -> DataFrame:
    """Checkpoint, and let Spark drop shuffle files of plans that nothing holds any more."""
    out = cut(df)
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


#: Documents looked at for common anchors (one in so many), contexts there that make an anchor common, anchors at most.
LOOK, COMMON, MOST_COMMON = 32, 256, 1024


def _common_anchors(texts: DataFrame, length: int, gram: int, schema: str) -> list[int]:
    """Anchors in many different contexts among some documents.  Which they are decides on tasks, never on results."""
    some = texts.where(F.expr(f"pmod(xxhash64(id), {LOOK}) = 0")).mapInArrow(_runs(length, gram), schema).where("counted % 2 = 0")
    each = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {COMMON}")
    return [r.anchor for r in each.orderBy(F.desc("n"), "anchor").limit(MOST_COMMON).collect()]


def repeated_intervals(
    docs: DataFrame, length: int = 100, gram: int = 32, bucket_bytes: int = 1 << 22, large: int = 8192,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, cuts): for each document with repeated bytes, its merged intervals (lo, hi) in order."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    schema = "id long, start long, counted long, anchor long, c1 long, c2 int"
    runs = texts.mapInArrow(_runs(length, gram), schema)
    # An anchor's runs meet in one task, those of a common anchor by context only: it counts as one of many contexts.
    frequent = _common_anchors(texts, length, gram, schema)
    common, by = F.lit(False), ["anchor"]
    if frequent:
        common, by = F.col("anchor").isin(frequent), ["anchor", "share"]
        runs = runs.withColumn("share", F.when(common, F.col("c1")).otherwise(F.col("anchor")))
    runs = runs.repartition(*by)
    same = W.partitionBy(*by, "c1", "c2").orderBy("id", "start")
    found = (
        runs.withColumn("_first", (F.row_number().over(same) == 1).cast("int"))
        .withColumn("_id0", F.first("id").over(same)).withColumn("_start0", F.first("start").over(same))
        .withColumn("contexts", F.sum("_first").over(W.partitionBy(*by)))
        .withColumn("later", F.expr("counted % 2 = 1") | ~((F.col("id") == F.col("_id0")) & (F.col("start") == F.col("_start0"))))
        .where(F.col("later") | common | (F.col("contexts") > 1))
        .select("id", "start", F.expr("counted div 2").alias("count"), "anchor", "later", (common | (F.col("contexts") > large)).alias("many"))
    )
    found = _released(found)
    known = found.where("later").select("id", F.col("start").alias("lo"), (F.col("start") + F.col("count") - 1 + length).alias("hi"))
    asked = found.where("NOT later").groupBy("id").agg(F.collect_list(F.struct("start", "count", "anchor", "many")).alias("runs"))
    ids = cut(found.where("NOT later").select("id").distinct())
    pieces = _released(
        join_by_size(texts, ids, "id", "left_semi").join(asked, "id")
        .mapInArrow(_contexts(length), "id long, start long, anchor long, many boolean, bytes binary")
    )
    volume = pieces.where("NOT many").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = -(-volume // bucket_bytes) or 1
    suffixes = (
        pieces.where("NOT many").withColumn("bucket", F.expr(f"pmod(xxhash64(anchor), {buckets})"))
        .select("bucket", "id", "start", "bytes").groupBy("bucket").applyInArrow(_factors(length), "id long, lo long, hi long")
    )
    strings = pieces.where("many").mapInArrow(_strings(length), "id long, start long, s1 long, s2 long")
    earliest = strings.groupBy("s1", "s2").agg(F.min(F.struct("id", "start")).alias("e"))
    others = strings.join(earliest, ["s1", "s2"]).where("struct(id, start) > e").select(
        "id", F.col("start").alias("lo"), (F.col("start") + length).alias("hi")
    )
    # Neighbours touch or overlap, so sorted intervals fold into the last one.
    merged = (
        known.unionByName(suffixes).unionByName(others)
        .groupBy("id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("cuts"))
        .mapInArrow(_fold, "id long, cuts array<struct<lo: bigint, hi: bigint>>")
    )
    return _released(merged)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        out = []
        for cuts in batch.column(1).to_pylist():
            held: list[dict] = []
            for c in cuts:
                if held and c["lo"] <= held[-1]["hi"]:
                    held[-1]["hi"] = max(held[-1]["hi"], c["hi"])
                else:
                    held.append(c)
            out.append(held)
        yield pa.record_batch([batch.column(0), pa.array(out, kind)], names=["id", "cuts"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes).

    Nulls: a null text has no bytes; a row with a null id matches nothing and is kept whole.  Repeated rows of one id
    are one document and each loses the same bytes.  Texts shorter than the length never match.  An empty table gives
    no rows; other columns are ignored.
    """
    cuts = repeated_intervals(docs, id_col=id_col, text_col=text_col, **options)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0
    both = texts.join(F.broadcast(cuts) if 16 * size <= BROADCAST_BYTES else cuts, "id", "left")
    return both.select("id", "text", "cuts").mapInArrow(
        _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
