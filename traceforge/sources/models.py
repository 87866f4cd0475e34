"""Trained models on disk: a pipeline, the features it takes in order, what is known about it, and its confidence curve.

A model is written to a folder of its own, then named as the current one by a small file that is replaced in one step, so that a
reader never meets half a model. The pipeline begins with the assembler of the listed features; loading checks that
they agree, and predicting checks the columns given, by name and by type, before Spark does anything.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import folders

CURVE = "threshold double, accuracy double, coverage double, n_calls long"
#: Thresholds without a curve, and where no threshold reaches the target.
NO_CURVE, NOT_REACHED = 0.5, 0.95


class FeatureError(ValueError):
    """Columns that don't fit a model's features."""


@dataclass(frozen=True)
class SavedModel:
    """A model as it is used: ``pipeline`` takes the numeric columns ``features``."""

    pipeline: PipelineModel
    features: list[str]
    meta: dict = field(default_factory=dict)
    curve: DataFrame | None = None

    def check(self, rows: DataFrame) -> None:
        """Raise ``FeatureError`` unless each feature is a numeric column of ``rows``."""
        types = {f.name: f.dataType for f in rows.schema.fields}
        missing = [f for f in self.features if f not in types]
        odd = [f for f in self.features if f in types and not isinstance(types[f], T.NumericType | T.BooleanType)]
        if missing or odd:
            raise FeatureError(f"missing features: {missing}; features that are no numbers: {odd}")

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what the pipeline adds. Nulls in features count as 0."""
        self.check(rows)
        return self.pipeline.transform(rows.fillna(0, subset=self.features))

    def threshold(self, target: float = 0.98) -> float:
        """The lowest threshold whose accuracy reaches ``target`` with some coverage; fixed ones without a curve, or where none does."""
        if self.curve is None:
            return NO_CURVE
        found = self.curve.where((F.col("accuracy") >= target) & (F.col("coverage") > 0)).agg(F.min("threshold")).first()[0]
        return NOT_REACHED if found is None else float(found)


def assembled(model: Model, features: list[str], into: str = "features") -> PipelineModel:
    """A fitted model behind the assembler of its features."""
    return PipelineModel([VectorAssembler(inputCols=features, outputCol=into), model])


def save_model(spark: SparkSession, path: str, saved: SavedModel) -> str:
    """Write a model below ``path`` and make it the current one; its folder. Earlier ones stay."""
    taken = saved.pipeline.stages[0].getInputCols()
    if taken != saved.features:
        raise FeatureError(f"the pipeline takes {taken}, not {saved.features}")
    name = f"models/{uuid.uuid4().hex}"
    at = f"{path}/{name}"
    saved.pipeline.save(f"{at}/pipeline")
    listed = spark.createDataFrame(list(enumerate(saved.features)), "place int, feature string")
    listed.coalesce(1).write.option("header", "true").csv(f"{at}/features")
    folders.write_text(spark, f"{at}/meta.json", json.dumps(saved.meta, sort_keys=True))
    if saved.curve is not None:
        saved.curve.select("threshold", "accuracy", "coverage", "n_calls").coalesce(1).write.option("header", "true").csv(f"{at}/curve")
    folders.publish_text(spark, f"{path}/current", name, replace=True)
    return at


def load_model(spark: SparkSession, path: str, name: str | None = None) -> SavedModel:
    """The current model below ``path``, or a named one; ``FileNotFoundError`` if there is none, ``FeatureError`` if its parts disagree."""
    if name is None:
        if not folders.exists(spark, f"{path}/current"):
            raise FileNotFoundError(f"no model at {path}: train and save one first")
        name = folders.read_text(spark, f"{path}/current")
    at = f"{path}/{name}"
    pipeline = PipelineModel.load(f"{at}/pipeline")
    listed = spark.read.option("header", "true").schema("place int, feature string").csv(f"{at}/features").collect()
    features = [r["feature"] for r in sorted(listed, key=lambda r: r["place"])]
    taken = list(pipeline.stages[0].getInputCols())
    if taken != features:
        raise FeatureError(f"the pipeline takes {taken}, the list says {features}")
    curve = spark.read.option("header", "true").schema(CURVE).csv(f"{at}/curve") if folders.exists(spark, f"{at}/curve") else None
    return SavedModel(pipeline, features, json.loads(folders.read_text(spark, f"{at}/meta.json")), curve)


def combined_features(saved: SavedModel, sets: dict[str, DataFrame]) -> str:
    """Which of several feature tables a model was made for: the first that has all its features; ``FeatureError`` if none has."""
    for name, rows in sets.items():
        if set(saved.features) <= set(rows.columns):
            return name
    raise FeatureError(f"none of {list(sets)} has all of {saved.features}")
