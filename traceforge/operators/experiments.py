"""Grids of learners compared on the same folds: one row of figures for each configuration, reruns alike.

Folds and the held-out part follow from a hash of each row's keys, so they don't depend on partitions or order. Each configuration is
cross-validated as by ``CrossValidator`` (mean and population deviation over the folds), then fitted to all training rows and judged on
the held-out ones, with its best confidence threshold.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import delete, work_folder
from .learning import best_threshold, confidence_curve

#: Rows that a task of a fit has at least.
ROWS_PER_TASK = 30_000
RESULT = "config string, learner string, n_features int, params string, cv_accuracy double, cv_deviation double, test_rows long, test_accuracy double, threshold double, threshold_accuracy double, threshold_coverage double"


@dataclass(frozen=True)
class Config:
    """A learner ('logistic', 'forest' or 'perceptron'), the features it sees, and its parameters by their ``pyspark.ml`` names (for perceptrons ``hidden``: sizes of the inner layers)."""

    name: str
    learner: str
    features: tuple[str, ...]
    params: dict = field(default_factory=dict)


def _learner(c: Config, classes: int, seed: int) -> Estimator:
    common = {"labelCol": "_label", "featuresCol": "_scaled"}
    if c.learner == "logistic":
        return LogisticRegression(weightCol="_weight", **common)
    if c.learner == "forest":
        return RandomForestClassifier(weightCol="_weight", seed=seed, **common)
    if c.learner == "perceptron":
        return MultilayerPerceptronClassifier(layers=[len(c.features), classes], seed=seed, **common)
    raise ValueError(f"no learner {c.learner!r}")


def _params(c: Config, learner: Estimator, classes: int) -> dict:
    known = {k: x for k, x in c.params.items() if k != "hidden"}
    if "hidden" in c.params:
        known["layers"] = [len(c.features), *c.params["hidden"], classes]
    return {learner.getParam(k): x for k, x in known.items()}


def folded(rows: DataFrame, label: str, keys: list[str], folds: int = 3, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """``rows`` with ``_fold`` (-1: held out), ``_label`` and ``_weight``, by which each class weighs as much as any other."""
    h = lambda n, k: F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(n)).cast("int")
    d = rows.where(F.col(label).isNotNull()).withColumns({"_label": F.col(label).cast("double"), "_fold": F.when(h(1000, seed) < int(1000 * test_share), -1).otherwise(h(folds, seed + 1))})
    n = d.groupBy("_label").agg(F.count(F.lit(1)).alias("_c"))
    return d.join(F.broadcast(n), "_label").withColumn("_weight", 1.0 / F.col("_c")).drop("_c")


def run_grid(rows: DataFrame, label: str, keys: list[str], configs: list[Config], folds: int = 3, test_share: float = 0.25, seed: int = 42, parallel: int = 4) -> DataFrame:
    """One row for each configuration (``RESULT``). ``label``: classes from 0; null features count as 0; ``keys`` tell rows apart.

    The rows are worked out once, dealt and sorted by ``keys``, so that forests too don't depend on how they came. Each fold and set of features is
    scaled once for all learners; ``parallel`` fits run beside each other, of any configuration and fold.
    """
    spark = rows.sparkSession
    sets = sorted({c.features for c in configs})
    used = sorted({f for s in sets for f in s})
    vector = {s: f"_features_{i}" for i, s in enumerate(sets)}
    held, path = [], work_folder(spark, "grid")
    try:
        # Kept as a table: the plans of some hundred jobs to come start there, the driver doesn't hold the features' own for each.
        rows.select(*keys, label, *used).where(F.col(label).isNotNull()).fillna(0, subset=used).write.parquet(path)
        known_rows = spark.read.parquet(path)
        n_rows, top = known_rows.agg(F.count(F.lit(1)), F.max(F.col(label).cast("double"))).first()
        classes = int(top) + 1
        learners = {c.name: _learner(c, classes, seed) for c in configs}
        # Few rows make few tasks: a fit is many short passes over them.
        d = folded(known_rows, label, keys, folds, test_share, seed).repartition(max(1, n_rows // ROWS_PER_TASK), *keys).sortWithinPartitions(*keys)
        for s in sets:
            d = VectorAssembler(inputCols=list(s), outputCol=vector[s]).transform(d)
        whole = d.select("_label", "_weight", "_fold", *vector.values()).persist()
        held.append(whole)
        found = {r["_fold"] for r in whole.groupBy("_fold").count().collect()}
        if empty := sorted({*range(folds)} - found):
            raise ValueError(f"no rows in folds {empty}")

        def scaled(part: tuple) -> tuple[DataFrame, DataFrame]:
            features, fold = part
            known = F.col("_fold") >= 0 if fold < 0 else (F.col("_fold") >= 0) & (F.col("_fold") != fold)
            scaler = StandardScaler(inputCol=vector[features], outputCol="_scaled", withMean=True).fit(whole.where(known))
            both = scaler.transform(whole).select("_label", "_weight", "_fold", "_scaled").persist()
            held.append(both)
            return both.where(known), both.where(F.col("_fold") == fold)

        def judged(job: tuple) -> float | tuple:
            c, fold = job
            train, test = parts[c.features, fold]
            result = learners[c.name].fit(train, _params(c, learners[c.name], classes)).transform(test)
            if fold >= 0:
                return MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy").evaluate(result)
            scored = result.select(F.array_max(vector_to_array("probability")).alias("conf"), (F.col("prediction") == F.col("_label")).alias("correct")).persist()
            try:
                n, accuracy = scored.agg(F.count(F.lit(1)), F.avg(F.col("correct").cast("double"))).first()
                best = best_threshold(confidence_curve(scored)).first()
            finally:
                scored.unpersist()
            return n, accuracy, best["threshold"], best["accuracy"], best["coverage"]

        with ThreadPool(parallel) as pool:  # as CrossValidator does it: fits are jobs of the cluster, threads only wait
            turns = [-1, *range(folds)]
            todo = [(s, k) for k in turns for s in sets]
            parts = dict(zip(todo, pool.map(inheritable_thread_target(spark)(scaled), todo)))
            jobs = [(c, k) for k in turns for c in configs]
            got = dict(zip([(c.name, k) for c, k in jobs], pool.map(inheritable_thread_target(spark)(judged), jobs, chunksize=1)))
    finally:
        for h in held:
            h.unpersist()
        delete(spark, path)
    out = []
    for c in configs:
        scores = [got[c.name, k] for k in range(folds)]
        out.append((c.name, c.learner, len(c.features), json.dumps(c.params, sort_keys=True), float(np.mean(scores)), float(np.std(scores)), *got[c.name, -1]))
    return spark.createDataFrame(out, RESULT)


def base_grid(levels: list[str], every: list[str]) -> list[Config]:
    """Twelve configurations: three learners, two sizes of each, on two sets of features."""
    out = []
    for name, features in (("level", tuple(levels)), ("all", tuple(every))):
        out += [Config(f"logistic_{name}_{r}", "logistic", features, {"regParam": r, "maxIter": 15}) for r in (0.01, 0.1)]
        out += [Config(f"forest_{name}_{d}", "forest", features, {"numTrees": 12, "maxDepth": d}) for d in (3, 6)]
        out += [Config(f"perceptron_{name}_{h}", "perceptron", features, {"hidden": [h], "maxIter": 20}) for h in (6, 12)]
    return out
