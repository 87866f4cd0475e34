"""Training data and its evaluation: emission matrices, classifiers, splits, weights, confidence curves."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stencils as st
from ..schema import CHANNELS, WELL
from .ranking import exact_rank
from .training import discriminant_sums


def emission(samples: DataFrame, base: str = "base", channels: list[str] = CHANNELS) -> DataFrame:
    """Mean intensities of each base over their sum: a row of the emission matrix."""
    d = samples.groupBy(base).agg(*[F.avg(c).alias(f"_{c}") for c in channels])
    total = F.expr("+".join(f"_{c}" for c in channels))
    return d.select(base, *[F.coalesce(F.try_divide(f"_{c}", total), F.lit(0.0)).alias(f"e_{c}") for c in channels])


def separation(emissions: DataFrame, base: str = "base", channels: list[str] = CHANNELS) -> np.ndarray | None:
    """The emission matrix's inverse (at most as many rows as bases reach the driver), or null if it is singular."""
    rows = emissions.orderBy(base).limit(len(channels) + 1).collect()
    m = np.array([[r[f"e_{c}"] for c in channels] for r in rows], float)
    return np.linalg.inv(m.T) if m.shape == (len(channels),) * 2 and abs(np.linalg.det(m)) > 1e-12 else None


def base_stats(samples: DataFrame, base: str = "base", channels: list[str] = CHANNELS) -> DataFrame:
    """Means over the greatest of them, and sample deviations, of each base."""
    d = samples.groupBy(base).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in channels], *[F.stddev_samp(c).alias(f"s_{c}") for c in channels])
    top = F.greatest(*[f"m_{c}" for c in channels])
    return d.withColumns({f"r_{c}": F.coalesce(F.try_divide(f"m_{c}", top), F.lit(0.0)) for c in channels})


def greatest_channel_base(channels: list[str] = CHANNELS, bases: str = "TGCA") -> Column:
    """The base of the greatest channel, the first of equals."""
    return F.element_at(F.array(*[F.lit(b) for b in bases]), st.argmax(channels) + 1)


def rule_base(c1: str = "c1", c2: str = "c2", c3: str = "c3", c4: str = "c4") -> Column:
    """A base by ordered rules on the channels: c1 leads T, c3 leads C, c2 near c1 is G, a c4 to c3 ratio in a band is A, else by the greatest."""
    a, b, c, d = (F.col(x) for x in (c1, c2, c3, c4))
    top = F.greatest(a, b, c, d)
    ratio = F.try_divide(d, c)
    return (
        F.when((a == top) & (a > 1.2 * b), "T").when((c == top) & (c > 1.2 * d), "C").when(b >= 0.9 * a, "G")
        .when((ratio >= 0.8) & (ratio <= 3.0), "A").otherwise(greatest_channel_base([c1, c2, c3, c4]))
    )


def matrix_calls(samples: DataFrame, matrix, channels: list[str] = CHANNELS, bases: str = "TGCA") -> DataFrame:
    """Unmix, cut negatives, take the greatest dye's base as ``called``."""
    dyes = ["d1", "d2", "d3", "d4"]
    d = samples.withColumns(dict(zip(dyes, st.unmixed(channels, matrix))))
    return d.withColumn("called", greatest_channel_base(dyes, bases))


def confusion(samples: DataFrame, truth: str, called: str) -> DataFrame:
    """Counts of truth and call, with each truth's share."""
    n = samples.groupBy(F.col(truth).alias("truth"), F.col(called).alias("called")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def discriminants(samples: DataFrame, label: str, channels: list[str], most: int = 4) -> np.ndarray:
    """Directions of linear discriminant analysis, best first, each of length 1 with its greatest entry positive; the scatter matrices come from one aggregate."""
    r, size = discriminant_sums(samples, label, channels).first(), len(channels)
    square = lambda m: np.array([[r[f"{m}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eig(np.linalg.pinv(square("w")) @ square("b"))
    best = vectors[:, np.argsort(-values.real, kind="stable")[:most]].real
    best = best / np.maximum(np.linalg.norm(best, axis=0), 1e-300)
    return best * np.sign(best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])])


def fitted_matrix(samples: DataFrame, label: str, channels: list[str] = CHANNELS, rounds: int = 100):
    """Weights that part the bases best: a multinomial logistic regression without intercept in place of a gradient-trained matrix."""
    d = VectorAssembler(inputCols=channels, outputCol="features").transform(samples)
    return LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", fitIntercept=False, regParam=0.01, maxIter=rounds).fit(d)


def window_classifier(windows: DataFrame, label: str, features: str, layers: list[int], seed: int = 42, rounds: int = 100):
    """A perceptron on flattened windows (a vector column), the native scorer of base windows."""
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol=features, layers=layers, seed=seed, maxIter=rounds).fit(windows)


def split(samples: DataFrame, label: str, key: list[str], seed: int = 42, train: float = 0.8, validate: float = 0.1) -> DataFrame:
    """Stratified split: within a class by rank of a seeded hash of the key, which a large class spreads by blocks of that hash."""
    h = F.xxhash64(*key, F.lit(seed))
    share = (F.pmod(h, F.lit(1_000_000)) + 0.5) / 1_000_000
    return samples.withColumn("part", F.when(share < train, "train").when(share < train + validate, "validate").otherwise("test"))


def ranked_split(samples: DataFrame, label: str, order: list[str], train: float = 0.8, validate: float = 0.1) -> DataFrame:
    """Exact stratified split by rank within the class, in ``order``: 80/10/10 of every class up to rounding. No task holds a whole class."""
    d = exact_rank(samples, [label], order, "_r", "_n")
    first, second = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validate)
    part = F.when(F.col("_r") <= first, "train").when(F.col("_r") <= first + second, "validate").otherwise("test")
    return d.withColumn("part", part).drop("_r", "_n")


def well_split(samples: DataFrame, seed: int = 42, train: float = 0.8) -> DataFrame:
    """Whole wells to train or test, by a seeded hash."""
    share = (F.pmod(F.xxhash64(*WELL, F.lit(seed)), F.lit(10_000)) + 0.5) / 10_000
    return samples.withColumn("part", F.when(share < train, "train").otherwise("test"))


def class_weights(samples: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """N / (k * n) of each of k classes; 0 for an empty one."""
    spark = samples.sparkSession
    n = samples.groupBy(F.col(label).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    all_ = spark.createDataFrame([(c,) for c in classes], "label long")
    d = all_.join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # one row per class
    return d.withColumn("weight", F.when(F.col("n") > 0, total / (len(classes) * F.col("n"))).otherwise(0.0))


def confidence_curve(scored: DataFrame, steps: int = 20) -> DataFrame:
    """Accuracy, coverage and calls at ``steps`` thresholds from 0 in steps of 0.05: all thresholds in one aggregation, which combines before its shuffle.

    ``scored``: conf, correct (boolean). Accuracy is 0 where nothing is called.
    """
    binned = scored.withColumn("bin", F.least(F.floor(F.col("conf") * 20 + 1e-9), F.lit(steps - 1))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("ok"))
    grid = scored.sparkSession.range(steps).select(F.col("id").alias("bin"))
    up = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)  # ``steps`` rows
    d = grid.join(binned, "bin", "left").fillna(0, ["n", "ok"]).withColumns({"calls": F.sum("n").over(up), "hits": F.sum("ok").over(up), "total": F.sum("n").over(Window.partitionBy())})
    return d.select((F.col("bin") / 20).alias("threshold"), F.coalesce(F.try_divide("hits", "calls"), F.lit(0.0)).alias("accuracy"), F.coalesce(F.try_divide("calls", "total"), F.lit(0.0)).alias("coverage"), F.col("calls").alias("n_calls"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of greatest accuracy * sqrt(coverage), the lowest of equals."""
    return curve.withColumn("value", F.round(F.col("accuracy") * F.sqrt("coverage"), 9)).orderBy(F.desc("value"), "threshold").limit(1)


def background(trace: DataFrame, peaks: DataFrame, radius: int, margin: int, per_well: int, seed: int = 42) -> DataFrame:
    """Scans farther than radius + margin from every peak and inside the trace: ``per_well`` of them by a seeded hash, label 4, quality 0.

    The distance to the nearest peak on both sides comes from two running windows over the merged scans, so no peak is paired with a scan.
    """
    at = peaks.select(*WELL, "scan").distinct().withColumn("_peak", F.col("scan"))
    w, back = st.scans(), st.scans().rowsBetween(0, Window.unboundedFollowing)
    d = trace.select(*WELL, "scan").join(at, [*WELL, "scan"], "left")
    d = d.withColumns({"_before": F.last("_peak", True).over(w), "_after": F.first("_peak", True).over(back), "_n": F.count(F.lit(1)).over(st.whole())})
    far = radius + margin
    clear = F.coalesce(F.col("scan") - F.col("_before") > far, F.lit(True)) & F.coalesce(F.col("_after") - F.col("scan") > far, F.lit(True))
    d = d.where(clear & (F.col("scan") >= radius) & (F.col("scan") < F.col("_n") - radius))
    order = Window.partitionBy(*WELL).orderBy(F.xxhash64("scan", F.lit(seed)), "scan")
    return d.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_well).select(*WELL, F.col("scan").alias("position"), F.lit(4).alias("label"), F.lit(0.0).alias("quality"))


def quality_filter(windows: DataFrame, least: float, with_background: bool = True) -> DataFrame:
    """Windows of a quality strictly over ``least``; background (label 4) passes or is left out."""
    good = F.col("quality") > least
    return windows.where((F.col("label") == 4) | good if with_background else good & (F.col("label") != 4))
