"""Leaderboards: error frame, dense matrix, rescaled loss, ranks, win rates, Elo and the tables behind plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import erf, exp, log10, pi, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.metrics import to_error


def error_frame(results: DataFrame) -> DataFrame:
    """(method, task, metric_error, train seconds, predict seconds) of selected rows with a test score."""
    return results.where("selected AND test_score IS NOT NULL").select(
        F.col("model").alias("method"),
        F.concat_ws("/", "dataset", "task").alias("task"),
        to_error(F.col("metric"), F.col("test_score")).alias("metric_error"),
        (F.col("fit_time_tuning") + F.col("fit_time_refit")).alias("time_train_s"),
        F.col("predict_time_refit").alias("time_infer_s"),
    )


def drop_incomplete(frame: DataFrame) -> DataFrame:
    """Tasks that every method has run."""
    methods = frame.agg(F.count_distinct("method").alias("_all"))
    full = frame.groupBy("task").agg(F.count_distinct("method").alias("_n")).crossJoin(F.broadcast(methods)).where("_n = _all")
    return frame.join(full.select("task"), "task", "left_semi")


def rescaled(frame: DataFrame) -> DataFrame:
    """``loss``: 0 for the best error of a task, 1 for the worst; 0 where all are equal."""
    w = W.partitionBy("task")
    low, high = F.min("metric_error").over(w), F.max("metric_error").over(w)
    return frame.withColumn("loss", F.when(high > low, (F.col("metric_error") - low) / (high - low)).otherwise(0.0))


def ranked(frame: DataFrame) -> DataFrame:
    """``rank`` within a task; ties share their average rank."""
    order = W.partitionBy("task").orderBy("metric_error")
    ties = W.partitionBy("task", "metric_error")
    return frame.withColumn("rank", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def pairwise(frame: DataFrame) -> DataFrame:
    """(a, b, wins, n): tasks both ran, and a's wins with ties as one half."""
    a = frame.select(F.col("method").alias("a"), "task", F.col("metric_error").alias("ea"))
    b = frame.select(F.col("method").alias("b"), "task", F.col("metric_error").alias("eb"))
    win = F.when(F.col("ea") < F.col("eb"), 1.0).when(F.col("ea") == F.col("eb"), 0.5).otherwise(0.0)
    return a.join(b, "task").where("a <> b").groupBy("a", "b").agg(F.sum(win).alias("wins"), F.count(F.lit(1)).alias("n"))


def win_rates(frame: DataFrame) -> DataFrame:
    return pairwise(frame).groupBy(F.col("a").alias("method")).agg((F.sum("wins") / F.sum("n")).alias("win_rate"))


def elo(pairs: Sequence[tuple[str, str, float, int]], anchor: str, at: float = 1000.0, steps: int = 2000) -> dict[str, float]:
    """Bradley-Terry strengths as Elo, 400 points a decade, the anchor at 1000; one method has no Elo.

    Minorise-maximise steps; half a win is added to each pair, so an undefeated method stays finite.
    """
    names = sorted({a for a, *_ in pairs})
    if len(names) < 2:
        return {}
    wins = {(a, b): w + 0.5 for a, b, w, _ in pairs}
    games = {(a, b): n + 1.0 for a, b, _, n in pairs}
    p = dict.fromkeys(names, 1.0)
    for _ in range(steps):
        new = {a: sum(w for (x, _), w in wins.items() if x == a) / sum(n / (p[a] + p[b]) for (x, b), n in games.items() if x == a) for a in names}
        scale = len(names) / sum(new.values())
        new = {a: v * scale for a, v in new.items()}
        moved = max(abs(new[a] - p[a]) for a in names)
        p = new
        if moved < 1e-12:
            break
    base = p.get(anchor, 1.0)
    return {a: at + 400.0 * log10(v / base) for a, v in p.items()}


def leaderboard(results: DataFrame, reference: DataFrame | None = None, methods: Sequence[str] | None = None, anchor: str = "constant-global") -> DataFrame:
    """One row per method: mean loss and rank, win rate, Elo, tasks, times; sorted by loss.  Methods are few."""
    frame = error_frame(results)
    if reference is not None:
        frame = frame.unionByName(reference, allowMissingColumns=True)
    if methods is not None:
        frame = frame.where(F.col("method").isin(list(methods)))
    frame = drop_incomplete(frame)
    pairs = [tuple(r) for r in pairwise(frame).collect()]  # methods squared
    scores = elo(pairs, anchor)
    spark: SparkSession = results.sparkSession
    table = ranked(rescaled(frame)).groupBy("method").agg(
        F.avg("loss").alias("loss_rescaled"), F.avg("rank").alias("rank"), F.count(F.lit(1)).alias("n_tasks"),
        F.median("time_train_s").alias("median_time_train_s"), F.median("time_infer_s").alias("median_time_infer_s"),
    ).join(win_rates(frame), "method", "left")
    points = spark.createDataFrame([*scores.items()], "method string, elo double")
    return table.join(F.broadcast(points), "method", "left").orderBy("loss_rescaled", "method")


def of_kind(frame: DataFrame, kinds: Mapping[str, str], kind: str) -> DataFrame:
    """Methods of a kind (``model`` or ``system``); unknown methods are models."""
    known = frame.sparkSession.createDataFrame([*kinds.items()] or [("", "")], "method string, kind string")
    both = frame.join(F.broadcast(known), "method", "left")
    return both.where(F.coalesce("kind", F.lit("model")) == kind).drop("kind")


def heatmap(frame: DataFrame, value: str = "loss") -> DataFrame:
    """The table behind a heat map: a row per task, a column per method."""
    return frame.groupBy("task").pivot("method").agg(F.first(value))


def range_quantile(k: int, level: float = 0.95) -> float:
    """The quantile of the range of ``k`` standard normal values: what a studentised range tends to with many tasks.

    The distribution ``k * int phi(z) * (Phi(z + q) - Phi(z)) ** (k - 1) dz`` by Simpson's rule, inverted by halving.
    """
    if k < 2:
        raise ValueError("a range has two values at least")
    normal = lambda x: 0.5 * (1.0 + erf(x / sqrt(2.0)))
    n, low, high = 800, 0.0, 40.0
    at = [-8.0 + 16.0 * i / n for i in range(n + 1)]
    weights = [(1 if i in (0, n) else 4 if i % 2 else 2) * 16.0 / n / 3 * exp(-z * z / 2) / sqrt(2 * pi) for i, z in enumerate(at)]
    for _ in range(60):
        q = (low + high) / 2
        below = k * sum(w * (normal(z + q) - normal(z)) ** (k - 1) for w, z in zip(weights, at, strict=True))
        low, high = (q, high) if below < level else (low, q)
    return (low + high) / 2


def critical_difference(frame: DataFrame, level: float = 0.95) -> DataFrame:
    """(method, rank, n_tasks, cd, n_alike): the data of a critical-difference diagram over tasks that all methods ran.

    Ranks that differ by ``cd`` or less are not told apart (Nemenyi); ``n_alike`` counts such methods, itself included.
    One method has no difference.
    """
    means = ranked(frame).groupBy("method").agg(F.avg("rank").alias("rank"), F.count(F.lit(1)).alias("n_tasks"))
    k = frame.select("method").distinct().count()
    q = range_quantile(k, level) / sqrt(2.0) if k > 1 else None
    means = means.withColumn("cd", F.lit(q).cast("double") * F.sqrt(F.lit(k * (k + 1)) / (6.0 * F.col("n_tasks"))))
    alike = F.abs(F.col("a.rank") - F.col("b.rank")) <= F.coalesce("a.cd", F.lit(0.0))
    return means.alias("a").join(F.broadcast(means.alias("b")), alike).groupBy("a.method", "a.rank", "a.n_tasks", "a.cd").agg(F.count(F.lit(1)).alias("n_alike"))


def load_reference(spark: SparkSession, path: str, methods: Sequence[str] | None = None) -> DataFrame:
    """Published results from a CSV with method, dataset, task, metric and value."""
    raw = spark.read.csv(path, header=True, schema="method string, dataset string, task string, metric string, value double")
    if methods is not None:
        raw = raw.where(F.col("method").isin(list(methods)))
    return raw.select("method", F.concat_ws("/", "dataset", "task").alias("task"), to_error(F.col("metric"), F.col("value")).alias("metric_error"))


def joined_one_to_one(predictions: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels with their predictions; either side's repeated keys are an error."""
    for name, side in (("predictions", predictions), ("labels", labels)):
        if side.groupBy(*keys).count().where("count > 1").head(1):
            raise ValueError(f"{name} repeat a key")
    return labels.join(predictions, list(keys), "left")


def with_meta(frame: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows with what is known of their method and task."""
    return frame.join(meta, ["method", "task"], "left")
