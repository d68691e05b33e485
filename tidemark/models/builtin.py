"""Built-in models: constants, boosted trees on entity attributes, boosted trees on multi-hop features."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import quoted
from tidemark.models.base import Draws, Grid, Model, register_model
from tidemark.models.constants import constant_scores, entity_scores
from tidemark.models.matrices import cached_features
from tidemark.operators import dfs
from tidemark.operators.features import FeaturePipeline, entity_features
from tidemark.operators.numbering import cut
from tidemark.operators.sampling import hard_pool, random_cap, soft_pool
from tidemark.sources.schema import RelDatabase, TaskSpec


@register_model("constant-global")
class ConstantGlobal(Model):
    def fit(self, task, db, train, val=None, *, seed=0, time_limit=None):
        self._train = train
        return self

    def predict(self, task: TaskSpec, db: RelDatabase, rows: DataFrame) -> DataFrame:
        return constant_scores(self._train, rows, task.target_col, task.kind)


@register_model("constant-per-entity")
class ConstantPerEntity(ConstantGlobal):
    def predict(self, task: TaskSpec, db: RelDatabase, rows: DataFrame) -> DataFrame:
        return entity_scores(self._train, rows, task.entity_col, task.target_col, task.kind)


class Boosted(Model):
    """Gradient-boosted trees on a typed feature frame; categories are frozen at fit, unseen ones are a value of their own."""

    def _features(self, task: TaskSpec, db: RelDatabase, rows: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
        raise NotImplementedError

    def _fit_frame(self, task: TaskSpec, frame: DataFrame, numbers: list[str], names: list[str], seed: int) -> PipelineModel:
        self._numbers, self._names = numbers, names
        stages = [StringIndexer(inputCols=[f"c{i}" for i in range(len(names))], outputCols=[f"k{i}" for i in range(len(names))], handleInvalid="keep")] if names else []
        inputs = [f"n{i}" for i in range(2 * len(numbers))] + [f"k{i}" for i in range(len(names))]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
        options = dict(
            labelCol="y", featuresCol="features", seed=seed, maxIter=int(self.config.get("rounds", 20)), maxDepth=int(self.config.get("depth", 4)),
            stepSize=float(self.config.get("rate", 0.1)), subsamplingRate=float(self.config.get("rows", 1.0)), maxBins=int(self.config.get("bins", 64)),
            minInstancesPerNode=int(self.config.get("least", 1)), minInfoGain=float(self.config.get("gain", 0.0)),
        )
        if "held" in frame.columns:  # rounds stop where the held rows' loss does
            options["validationIndicatorCol"] = "held"
        tree = GBTClassifier(**options) if task.kind == "binary_classification" else GBTRegressor(lossType="absolute", **options)
        ready = self._plain(frame).withColumn("y", F.col(quoted(task.target_col)).cast("double"))
        return Pipeline(stages=[*stages, tree]).fit(ready)

    def _plain(self, frame: DataFrame) -> DataFrame:
        """Numbers with a flag for null beside each, and strings with null as a word: trees take no nulls."""
        out = frame
        have = set(frame.columns)
        for i, c in enumerate(self._numbers):
            v = F.col(quoted(c)) if c in have else F.lit(None).cast("double")
            out = out.withColumn(f"n{2 * i}", F.coalesce(v, F.lit(0.0))).withColumn(f"n{2 * i + 1}", v.isNull().cast("double"))
        for i, c in enumerate(self._names):
            v = F.col(quoted(c)) if c in have else F.lit(None).cast("string")
            out = out.withColumn(f"c{i}", F.coalesce(v, F.lit("(missing)")))
        return out

    def fit(self, task, db, train, val=None, *, seed=0, time_limit=None):
        train = _numbered(train, task)
        self._prepare(task, db, train)
        chosen = self._context(task, train, seed).withColumn("held", F.lit(False))
        if val is not None:
            chosen = chosen.unionByName(_numbered(val, task).select(train.columns).withColumn("held", F.lit(True)))
        chosen = cut(chosen)
        frame, numbers, names = self._features(task, db, chosen.drop("held"))
        if val is not None:
            frame = frame.join(chosen.select("row_id", "held"), "row_id")
        self._constant = frame.select(task.target_col).distinct().limit(2).count() < 2
        self._train = train
        if not self._constant:
            frame = cut(frame)
            self._models = [self._fit_frame(task, one, numbers, names, seed) for one in self._draws(frame)]
        return self

    def _draws(self, frame: DataFrame) -> list[DataFrame]:
        """The frames that a model each is fitted on; their scores are averaged."""
        return [frame]

    def _prepare(self, task: TaskSpec, db: RelDatabase, train: DataFrame) -> None:
        """What prediction needs of the training labels."""

    def _context(self, task: TaskSpec, train: DataFrame, seed: int) -> DataFrame:
        return train

    def predict(self, task: TaskSpec, db: RelDatabase, rows: DataFrame) -> DataFrame:
        if self._constant:  # one class or value only: trees cannot be grown
            return constant_scores(self._train, rows, task.target_col, task.kind)
        keyed = cut(_numbered(rows, task))
        frame, _, _ = self._features(task, db, keyed)
        ready = self._plain(frame)
        ready = cut(ready) if len(self._models) > 1 else ready
        score = vector_to_array("probability")[1] if task.kind == "binary_classification" else F.col("prediction")
        parts = [m.transform(ready).select("row_id", score.alias("score")) for m in self._models]
        return keyed.join(parts[0] if len(parts) == 1 else ensemble(parts, ["row_id"]), "row_id", "left").drop("row_id")


def _numbered(rows: DataFrame, task: TaskSpec) -> DataFrame:
    """A row id from (time, entity), which are unique in label tables."""
    return rows.withColumn("row_id", F.concat_ws("|", F.col(quoted(task.time_col)).cast("string"), F.col(quoted(task.entity_col)).cast("string")))


def _split(frame: DataFrame, task: TaskSpec, names: list[str]) -> tuple[list[str], list[str]]:
    skip = {"row_id", task.target_col, task.entity_col}
    names = [n for n in names if n not in skip]
    return [c for c, k in frame.dtypes if k == "double" and c not in skip and c not in names], names


@register_model("gbt", Draws({"rounds": 20, "depth": 4}, rounds=[10, 20, 40], depth=[2, 4, 6], rate=(0.03, 0.3), rows=[0.6, 0.8, 1.0], bins=[32, 64, 128], least=[1, 5, 20], gain=[0.0, 0.001]))
class EntityBoosted(Boosted):
    """Entity attributes only."""

    def _features(self, task, db, rows):
        frame, names = entity_features(rows.withColumn("_y", F.col(task.target_col).cast("double") if task.target_col in rows.columns else F.lit(None).cast("double")),
                                       db, task.entity_table, task.entity_col, task.time_col, task.target_col)
        frame = frame.withColumnRenamed("_y", task.target_col)
        numbers, names = _split(frame, task, names)
        return frame, numbers, names


@register_model("dfs-gbt", Grid(*({"max_depth": d} for d in (2, 3, 4))))
class AggregateBoosted(Boosted):
    """Multi-hop features with label history, calendar and lags; a context strategy bounds the training rows.

    With ``estimators`` above one and a pool, each estimator is fitted on a draw of its own and scores are averaged.
    """

    def _prepare(self, task, db, train):
        self._history = train.select(task.time_col, task.entity_col, task.target_col)
        self._pipeline = FeaturePipeline(
            task.entity_table, task.entity_col, task.time_col, task.target_col, self.config.get("calendar", True), int(self.config.get("lags", 2)), False
        ).fit(db, self._history)

    def _context(self, task, train, seed):
        most, self._pool = self.config.get("max_rows"), None
        if not most:
            return train
        how = self.config.get("context", "random")
        if how == "random":
            return random_cap(train, "row_id", most, seed, task.target_col if task.kind == "binary_classification" else None)
        pool = {"hard_pool": hard_pool, "soft_pool": soft_pool}[how](train, task.time_col, "row_id", most, 2 * most, int(self.config.get("estimators", 1)), seed)
        if pool is None:
            return train
        self._pool = cut(pool)
        return train.join(self._pool.select("row_id"), "row_id", "left_semi")

    def _draws(self, frame):
        if self._pool is None or int(self.config.get("estimators", 1)) < 2:
            return [frame]
        held = F.col("held") if "held" in frame.columns else F.lit(False)
        drawn = lambda e: frame.join(self._pool.where(F.col("est") == e).select("row_id", F.lit(True).alias("_in")), "row_id", "left")
        return [drawn(e).where(held | F.col("_in").isNotNull()).drop("_in") for e in range(int(self.config["estimators"]))]

    def _features(self, task, db, rows):
        target = rows.select("row_id", F.col(task.target_col).cast("double").alias("_y")) if task.target_col in rows.columns else None
        base = rows.drop(task.target_col)
        depth = int(self.config.get("max_depth", 2))
        keys = [task.time_col, task.entity_col]
        matrix = base.join(cached_features(base.sparkSession, self.cache, db, task, base, self._history, max(depth, self.deepest or 0), depth), keys, "left")
        matrix = self._pipeline.transform(db, matrix)
        keyed = matrix.withColumn("_id", F.col("row_id"))
        frame, names = dfs.finished(keyed, task.entity_col, task.time_col)
        names = [n for n in names if n not in ("_id", "row_id")]
        if target is not None:
            frame = frame.join(target, "row_id").withColumnRenamed("_y", task.target_col)
        numbers, names = _split(frame, task, names)
        return frame, numbers, names


def ensemble(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Mean score per row over several models' predictions."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.avg("score").alias("score"))
