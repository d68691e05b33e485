"""Feature frames: entity attributes, and the fixed pipeline calendar -> lags -> text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import calendar, cyclic, quoted, typed_columns
from tidemark.operators.asof import asof_lags, lookup_text
from tidemark.sources.schema import RelDatabase


def entity_features(labels: DataFrame, db: RelDatabase, entity: str, entity_col: str, time_col: str, target_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """The entity's own columns beside each label row; keys, references, target and lists stay out."""
    t = db[entity]
    kind = labels.schema[entity_col].dataType
    keep = [c for c in t.df.columns if c not in {t.pkey, *t.fkeys}]
    renamed = [F.col(quoted(c)).alias(c if c not in labels.columns else f"{entity}.{c}") for c in keep]
    own = t.df.select(F.col(quoted(t.pkey)).cast(kind).alias("_k"), *renamed)
    joined = labels.join(own, F.col(quoted(entity_col)) == F.col("_k"), "left")
    return typed_columns(joined, ("_k", entity_col, *([target_col] if target_col else [])))


def text_columns(db: RelDatabase, entity: str) -> list[str]:
    t = db[entity]
    return [f.name for f in t.df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in {t.pkey, *t.fkeys}]


@dataclass
class FeaturePipeline:
    """Lazy steps in a fixed order.  The lag pool and the text columns are frozen when it is fitted."""

    entity: str
    entity_col: str
    time_col: str
    target_col: str
    use_calendar: bool = True
    lags: int = 0
    use_text: bool = False
    _pool: DataFrame | None = None
    _texts: list[str] = field(default_factory=list)

    def fit(self, db: RelDatabase, train: DataFrame) -> FeaturePipeline:
        self._pool = train.select(quoted(self.entity_col), quoted(self.time_col), quoted(self.target_col))
        self._texts = text_columns(db, self.entity) if self.use_text else []
        return self

    def transform(self, db: RelDatabase, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
        """Adds columns; rows must carry ``row_id``, which stands for their order."""
        if self._pool is None:
            raise ValueError("fit the pipeline first")
        out = rows
        if self.use_calendar:
            at = F.col(quoted(self.time_col))
            out = out.select("*", *calendar(at, "anchor_"), *cyclic(at, "anchor_"))
        if self.lags:
            out = asof_lags(out, self._pool, self.entity_col, self.time_col, self.target_col, self.lags, row_id)
        if self._texts:
            t = db[self.entity]
            out = lookup_text(out, self.entity_col, t.df, t.pkey, self._texts)
        return out
