"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled table (at most ``MAX_LABELLED`` rows) and has ``2 ** bits``
weights, so what goes to the executors has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import chunks, windows

MAX_LABELLED = 10_000

#: The table that is used where no other is given: a label (1 unwanted, 0 wanted) and a url a line.
TABLE = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: str | Path = TABLE) -> list[tuple[str, int]]:
    """URLs with 1 for unwanted and 0 for wanted, from a file of tab-separated lines; ``#`` starts a comment."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    return [(url, int(label)) for label, url in rows]


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut_at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut_at:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    host = rest[:cut_at].translate({c: c + 32 for c in range(65, 91)})
    return host, tail[:end]


def grams(parts: pa.Array, bits: int, widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and signed bucket numbers (bucket * 2 + sign) of all n-grams of a batch of strings."""
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, _, buf, bounds in chunks(parts):
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for n in widths:
            hashed = windows(buf, n)
            start = np.flatnonzero(owner[: len(hashed)] == owner[n - 1 :]) if len(hashed) else np.zeros(0, np.int64)
            rows.append(owner[start] + first)
            cells.append(hashed[start] >> np.uint64(63 - bits))
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64)


def _marked(hosts: Sequence[str], paths: Sequence[str]) -> pa.Array:
    return pa.array([f"^{h}$\t{p}" for h, p in zip(hosts, paths, strict=True)], pa.string())


def _scores(marked: pa.Array, weights: np.ndarray, bias: float, bits: int, widths: Sequence[int]) -> np.ndarray:
    rows, cells = grams(marked, bits, widths)
    n = len(marked)
    signed = weights[cells >> 1] * (1.0 - 2.0 * (cells & 1))
    count = np.bincount(rows, minlength=n)
    return bias + np.bincount(rows, signed, minlength=n) / np.sqrt(np.maximum(count, 1))


def fit(
    labelled: Sequence[tuple[str, int]], bits: int = 14, widths: Sequence[int] = (3, 4, 5), penalty: float = 1e-4, steps: int = 600, care: float = 0.85
) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum on the penalised log-likelihood.

    ``care`` is the weight of all wanted urls together, the unwanted have the rest: above one half, doubt means allow.
    """
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    hosts, paths = zip(*(split_url(u) for u, _ in labelled), strict=True)
    y = np.array([float(v) for _, v in labelled])
    rows, cells = grams(_marked(hosts, paths), bits, widths)
    value = (1.0 - 2.0 * (cells & 1)) / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))[rows]
    column = cells >> 1
    each = np.where(y > 0, (1 - care) / max(y.sum(), 1), care / max((1 - y).sum(), 1))
    w, b, move, drift = np.zeros(1 << bits), 0.0, np.zeros(1 << bits), 0.0
    for _ in range(steps):
        z = b + np.bincount(rows, w[column] * value, minlength=len(y))
        error = each * (1 / (1 + np.exp(-z)) - y)
        move = 0.9 * move - 2.0 * (np.bincount(column, error[rows] * value, minlength=1 << bits) + penalty * w)
        drift = 0.9 * drift - 2.0 * error.sum()
        w, b = w + move, b + drift
    return w, b


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    labelled: Sequence[tuple[str, int]] | None = None,
    threshold: float = 0.5,
    bits: int = 14,
    widths: Sequence[int] = (3, 4, 5),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    ``labelled`` are (url, 1 for unwanted or 0 for wanted), at most ``MAX_LABELLED``; without it ``TABLE`` is read.

    ``rules`` are (host, path, verdict), few enough for one expression; the longest that fits decides.  Else the verdict
    is ``block`` where the model's probability reaches ``threshold``.

    Nulls: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed with a null score,
    as the model has nothing to judge.  Repeated rows get the same answer; an empty table gives none; other columns are
    ignored.
    """
    weights, bias = fit(labelled_urls() if labelled is None else labelled, bits, widths)
    rest = F.expr(f"substring({_quoted(url_col)}, instr({_quoted(url_col)}, '://') + 3)")
    has = F.coalesce(F.expr(f"instr({_quoted(url_col)}, '://') > 0"), F.lit(False))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.when(has, F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), upper, lower)).otherwise("").alias("host"),
        F.when(has, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise("").alias("path"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            got = _scores(_marked(hosts, paths), weights, bias, bits, widths)
            empty = np.array([not h and not p for h, p in zip(hosts, paths, strict=True)], bool)
            probability = pa.array(1 / (1 + np.exp(-got)), mask=empty)
            yield pa.record_batch([*batch.columns, probability], names=["page_id", "host", "path", "score"])

    scored = rows.mapInArrow(score, "page_id long, host string, path string, score double")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
