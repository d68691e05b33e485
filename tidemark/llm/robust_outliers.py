"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every text gives counts (words, symbols, repeated lines and windows, capitals, digits, punctuation, distinct words) and
from them a vector of transformed statistics.  For each (language, source), each language and the whole corpus the
minimum covariance determinant is estimated over all eligible rows:

1. Three deterministic starts: median and interquartile spread as the scatter, and the correlations of hyperbolic
   tangents and of spatial signs of the standardised rows.
2. Concentration steps: distances to centre and scatter, the closest ``core`` share of rows, their moments again.  After
   two steps the start with the least determinant goes on, until log determinants stand still or ``steps`` are done.
3. Distances are scaled so that their median is that of the chi-square law; rows within its 97.5 % quantile are
   measured once more, and that scatter is raised by the consistency factor of the truncated normal law.

The ``core`` share is found on a logarithmic grid of distances (``GRID`` cells an octave) and ends with a whole cell.  All
of it is partial aggregates, so a group of any size is never gathered.  A text is rejected if its squared Mahalanobis
distance in the smallest of its groups that has ``least_rows`` rows, shrunk by n / (n + ``shrink_words``) as a short
text's statistics are noisy, passes a chi-square quantile.  A fixed variance per statistic is added to each scatter (the
regularised estimate), as most statistics hardly vary among clean texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Settled, cut, fresh, settle, small_batches
from tidemark.llm.text import _SPACE, chunks, spans, words

WINDOW = 8

#: One over the rank error of the quartiles that the starts are made from; nothing later depends on sketches.
ACCURACY = 1_000

#: Cells an octave of the grid of squared distances.
GRID = 16

#: Change of a log determinant that counts as none: the share of rows is only found to a cell.
STILL = 0.02

#: Names of the statistics and the least standard deviation each is taken to have, in transformed units.
STATISTICS = {
    "symbols": 0.06,
    "word_length": 0.15,
    "capitals": 0.08,
    "digits": 0.08,
    "punctuation": 0.10,
    "repeated_words": 0.15,
    "repeated_lines": 0.15,
    "lone_symbols": 0.08,
    "echoes": 0.08,
}

_kinds = {}
for _name, _chars in {
    "symbol": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "letter": bytes(range(65, 91)) + bytes(range(97, 123)),
    "digit": b"0123456789",
    "point": b".,;:!?()[]{}\"'-_/\\@+=~^`",
}.items():
    _kinds[_name] = np.zeros(256, bool)
    _kinds[_name][list(_chars)] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _seen(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether an equal one of the same owner stands before it, and whether any other equals it."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    before, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    before[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    twice[order] = either
    return before, twice


def text_counts(buf: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts per text of a chunk."""
    n = len(bounds) - 1
    starts, ends, first = words(buf, bounds)
    n_words = np.diff(first)
    space = _SPACE[buf]
    out = {
        "n_words": n_words,
        "word_chars": _per(_LEAD[buf] & ~space, bounds),
        "n_symbols": _per(_kinds["symbol"][buf], bounds),
        "upper": _per(_kinds["upper"][buf], bounds),
        "letters": _per(_kinds["letter"][buf], bounds),
        "digits": _per(_kinds["digit"][buf], bounds),
        "points": _per(_kinds["point"][buf], bounds),
    }
    # Lines: pieces between line feeds; lexsort is stable, so the first of equal lines stays first.
    feeds = np.flatnonzero(buf == 10)
    line_starts = np.unique(np.concatenate((bounds[:-1], feeds + 1)))
    line_starts = line_starts[line_starts < len(buf)]
    owner = np.searchsorted(bounds, line_starts, "right") - 1
    line_ends = np.minimum(bounds[owner + 1], np.concatenate((feeds, [len(buf)]))[np.searchsorted(feeds, line_starts)])
    # An empty line at a border starts where the next text does: it has no word anyway.
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, owner = line_starts[worded], line_ends[worded], owner[worded]
    before, _ = _seen(spans(buf, line_starts, line_ends), owner)
    out["n_dup_lines"] = np.bincount(owner[before], minlength=n)
    out["n_lines"] = np.bincount(owner, minlength=n)
    # Words in windows found twice or more.
    hashed = spans(buf, starts, ends)
    owner = np.repeat(np.arange(n), n_words)
    covered = np.zeros(len(hashed) + 1, np.int64)
    if len(hashed) >= WINDOW:
        m = len(hashed) - WINDOW + 1
        rolled = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashed[k : k + m]
        inside = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
        _, twice = _seen(rolled[inside], owner[inside])
        at = inside[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=n)
    alone = (ends - starts == 1) & _kinds["symbol"][buf[starts]] if len(starts) else np.zeros(0, bool)
    out["alone"] = np.bincount(owner[alone], minlength=n)
    echo = np.flatnonzero((hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])) + 1
    out["echoes"] = np.bincount(owner[echo], minlength=n)
    return out


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, one row per text: shares by arcsine of the root, lengths by logarithm."""
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))

    return np.stack(
        [
            share(c["n_symbols"], chars),
            np.log(chars / n),
            share(c["upper"], c["letters"]),
            share(c["digits"], chars),
            share(c["points"], chars),
            share(c["n_repeat_words"], n),
            share(c["n_dup_lines"], c["n_lines"]),
            share(c["alone"], n),
            share(c["echoes"], n),
        ],
        1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, buf, bounds in chunks(batch.column("text")):
            counts = text_counts(buf, bounds)
            x = statistics(counts)
            rest = batch.slice(first, last - first).drop_columns(["text"])
            yield pa.record_batch(
                [*rest.columns, *[pa.array(counts[k].astype(np.int64)) for k in COUNTS], *[pa.array(x[:, i]) for i in range(x.shape[1])]],
                names=[*rest.schema.names, *COUNTS, *[f"x{i}" for i in range(x.shape[1])]],
            )


def chi_square(p: float, k: int) -> float:
    """Quantile by the Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def chi_square_share(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def _distance(p: int) -> Column:
    """Squared distance from columns x, centre m and lower-triangular whitening w."""
    rows = []
    for i in range(p):
        line = " + ".join(f"w{i}_{j} * (x{j} - m{j})" for j in range(i + 1))
        rows.append(f"pow({line}, 2)")
    return F.expr(" + ".join(rows))


def _lower(p: int, name: str) -> list[str]:
    return [f"{name}{i}_{j}" for i in range(p) for j in range(i + 1)]


def _products(columns: Sequence[Column], name: str) -> list[Column]:
    return [F.sum(columns[i] * columns[j]).alias(f"{name}{i}_{j}") for i in range(len(columns)) for j in range(i + 1)]


def _matrix(row: dict, name: str, p: int) -> np.ndarray:
    return np.array([[row[f"{name}{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])


def _fits(p: int, keys: Sequence[str], floor: np.ndarray, solve):
    """Rows of aggregates to rows of keys, start, log determinant, centre and whitening; ``solve`` gives (start, centre, scatter)."""
    names = [*keys, "start", "logdet", *[f"m{i}" for i in range(p)], *_lower(p, "w")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in batch.to_pylist():
                for start, centre, scatter in solve(row):
                    root = np.linalg.cholesky(scatter + np.diag(floor * floor))
                    w = np.linalg.inv(root)
                    values = [*[row[k] for k in keys], start, float(2 * np.log(np.diag(root)).sum()), *centre.tolist(), *[float(w[i, j]) for i in range(p) for j in range(i + 1)]]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.int64() if k in (*keys, "start") else pa.float64() for k in names]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    schema = ", ".join(f"{k} {'long' if k in (*keys, 'start') else 'double'}" for k in names)
    return run, schema


def estimate(levels: DataFrame, floor: Sequence[float], core: float = 0.75, steps: int = 6, least_rows: int = 200) -> Settled:
    """Rows (g long, x0, x1, ...) to one row a group: g, m (centre) and w (lower-triangular whitening of the scatter).

    Groups with fewer than ``least_rows`` rows have none.
    """
    p, xs = len(floor), [f"x{i}" for i in range(len(floor))]
    floor = np.array(floor, float)
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    rough = levels.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, quartiles, ACCURACY).alias(f"_{x}") for x in xs]).where(f"n >= {least_rows}")
    rough = settle(
        rough.select(
            "g", *[F.expr(f"_x{i}[1]").alias(f"m{i}") for i in range(p)],
            *[F.expr(f"sqrt(pow((_x{i}[2] - _x{i}[0]) / 1.349, 2) + {float(floor[i]) ** 2!r})").alias(f"d{i}") for i in range(p)],
        )
    ).side
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(p)]
    near = F.greatest(sum((c * c for c in z), F.lit(0.0)), F.lit(1e-12))
    shaped = levels.join(rough, "g").select(
        "g", *[f"m{i}" for i in range(p)], *[f"d{i}" for i in range(p)],
        *[F.tanh(c).alias(f"t{i}") for i, c in enumerate(z)], *[(c / F.sqrt(near)).alias(f"u{i}") for i, c in enumerate(z)],
    )
    shaped = shaped.groupBy("g").agg(
        *[F.first(f"{c}{i}").alias(f"{c}{i}") for c in "md" for i in range(p)],
        *_products([F.col(f"t{i}") for i in range(p)], "a"), *_products([F.col(f"u{i}") for i in range(p)], "b"),
    )

    def starts(row: dict):
        centre, spread = (np.array([row[f"{c}{i}"] for i in range(p)]) for c in "md")
        yield 0, centre, np.diag(spread * spread)
        for k, name in ((1, "a"), (2, "b")):
            moment = _matrix(row, name, p)
            size = np.sqrt(np.diag(moment))
            flat = size <= 1e-9 * max(size.max(), 1e-300)
            size[flat] = 1.0
            shape = moment / np.outer(size, size)
            shape[flat, :] = shape[:, flat] = 0.0
            np.fill_diagonal(shape, 1.0)
            yield k, centre, np.outer(spread, spread) * (0.95 * shape + 0.05 * np.eye(p))

    run, schema = _fits(p, ["g"], floor, starts)
    fitted = settle(shaped.mapInArrow(run, schema))
    d2, parameters = _distance(p), [f"m{i}" for i in range(p)] + _lower(p, "w")
    # Distances over 2 ** 40 are all far; the grid so has a bounded number of cells.
    cell = F.expr(f"int(floor(log2(least(greatest(d2, {2.0**-20!r}), {2.0**40!r})) * {GRID}))")
    sums = [F.sum(x).alias(f"s{x[1:]}") for x in xs]

    def counted(now: Settled) -> DataFrame:
        return levels.join(now.side, "g").select("g", "start", d2.alias("d2")).groupBy("g", "start", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))

    def share(cells: DataFrame, part: float) -> DataFrame:
        """The cell in which the share of rows ends, and the squared distance at which it does."""
        group = Window.partitionBy("g", "start")
        up_to = F.sum("n").over(group.orderBy("cell"))
        found = cells.select("g", "start", "cell", "n", up_to.alias("upto"), F.sum("n").over(group).alias("all")).where(F.col("upto") >= F.ceil(part * F.col("all")))
        first = found.groupBy("g", "start").agg(F.min(F.struct("cell", "n", "upto", "all")).alias("e"))
        inside = (F.ceil(part * F.col("e.all")) - F.col("e.upto") + F.col("e.n")) / F.col("e.n")
        return first.select("g", "start", F.col("e.cell").alias("top"), F.pow(F.lit(2.0), (F.col("e.cell") + inside) / GRID).alias("end"))

    def solve(row: dict):
        n = max(row["n"], 1)
        centre = np.array([row[f"s{i}"] for i in range(p)]) / n
        yield row["start"], centre, _matrix(row, "q", p) / n - np.outer(centre, centre)

    def measured(now: DataFrame, within: Column, solver) -> DataFrame:
        rows = levels.join(now, "g").select("g", "start", *[c for c in ("top", "end") if c in now.columns], *xs, d2.alias("d2")).where(within)
        moments = rows.groupBy("g", "start").agg(F.count(F.lit(1)).alias("n"), *sums, *_products([F.col(x) for x in xs], "q"))
        run, schema = _fits(p, ["g"], floor, solver)
        return moments.mapInArrow(run, schema)

    for step in range(steps):
        top = share(counted(fitted), core)
        now = settle(fitted.frame.withColumnRenamed("logdet", "before").join(top, ["g", "start"]))
        after = measured(now.side, cell <= F.col("top"), solve)
        if step == 1:  # the start with the least determinant goes on
            best = Window.partitionBy("g").orderBy("logdet", "start")
            after = after.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
        after = after.join(now.side.select("g", "start", "before"), ["g", "start"])
        fitted = settle(after, moved=F.max(F.abs(F.col("logdet") - F.col("before"))))
        fitted = fitted._replace(frame=fitted.frame.drop("before"))
        if step > 1 and (fitted.seen["moved"] or 0.0) < STILL:
            break
    middle, most = chi_square(0.5, p), chi_square(0.975, p)
    raised = 0.975 / chi_square_share(most, p + 2)

    def last(row: dict):
        for start, centre, scatter in solve(row):
            yield start, centre, scatter * raised

    end = share(counted(fitted), 0.5)
    now = settle(fitted.frame.join(end, ["g", "start"]))
    return settle(measured(now.side, F.col("d2") <= F.col("end") / middle * most, last).select("g", *parameters))


def quality(
    docs: DataFrame,
    core: float = 0.75,
    steps: int = 6,
    least_rows: int = 200,
    tail: float = 1e-7,
    shrink_words: int = 60,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, distance (null where none was taken), text_key.

    ``base_failed``: fewer than ``least_words`` words, or over 30 % of words in repeated windows.  ``kept`` is false for those and
    for outliers.  Documents of a group, language and corpus with fewer than ``least_rows`` eligible rows are kept, as
    nothing can be estimated.

    Nulls: a null text has no words and fails if ``least_words`` is positive; null language or source is a value of its own; null ids are passed on.
    Repeated rows count as often as they stand.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    p = len(STATISTICS)

    def group(level: str, *columns: str) -> Column:
        return F.xxhash64(F.lit(level), *[x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        group("source", lang_col, source_col).alias("g_source"),
        group("language", lang_col).alias("g_lang"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id long, text_key long, g_source long, g_lang long, " + ", ".join(
        [f"{c} long" for c in COUNTS] + [f"x{i} double" for i in range(p)]
    )
    measured = cut(
        rows.mapInArrow(_measure, schema).withColumn(
            "base_failed", F.expr(f"n_words < {least_words} OR 100 * n_repeat_words > 30 * n_words")
        )
    )
    eligible = measured.where("NOT base_failed")
    whole = F.lit(0).cast("long")
    levels = eligible.select(F.explode(F.array("g_source", "g_lang", whole)).alias("g"), *[f"x{i}" for i in range(p)])
    fitted = estimate(levels, list(STATISTICS.values()), core, steps, least_rows)
    known = fitted.side.select("g")
    named = eligible.join(known.select(F.col("g").alias("g_source"), F.lit(1).alias("_s")), "g_source", "left")
    named = named.join(known.select(F.col("g").alias("g_lang"), F.lit(1).alias("_l")), "g_lang", "left").withColumn(
        "g", F.when(F.col("_s").isNotNull(), F.col("g_source")).when(F.col("_l").isNotNull(), F.col("g_lang")).otherwise(whole)
    )
    chosen = named.join(fitted.side, "g", "left").withColumn("distance", _distance(p) * F.col("n_words") / (F.col("n_words") + shrink_words))
    names = ["doc_id", *COUNTS, "base_failed", "kept", "distance", "text_key"]
    cutoff = chi_square(1 - tail, p)
    return chosen.withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(True))).select(names).unionByName(
        measured.where("base_failed").withColumn("kept", F.lit(False)).withColumn("distance", F.lit(None).cast("double")).select(names)
    )


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns."""
    judged = quality(docs, id_col=id_col, text_col=text_col, **options)
    key, crc, own = fresh(docs, "_tm_id", "_tm_key", "_tm_text")
    gone = judged.where("NOT kept").select(F.col("doc_id").alias(key), F.col("text_key").alias(crc)).distinct()
    found = docs.withColumn(own, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(crc))
    return found.join(gone, same, "left_anti").drop(own)
