"""Genotyping: trace features, scaling by plate, calls, mutant fractions, and validation against truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as k
from ..functions import stencils as st
from ..schema import CHANNELS, FEATURE_REGION, GENOTYPES, NOISE_SCANS, WELL
from . import peaks as pk
from .joins import by_group


def trace_stats(trace: DataFrame, channels: list[str] = CHANNELS, more: Sequence[Column] = ()) -> DataFrame:
    """Ten statistics of each channel and well: population deviation, biased skewness and excess kurtosis, exact percentiles. ``more``: further aggregates of the same pass.

    The percentiles come from a well's sorted values in an aggregate of their own: beside them Spark compiles no aggregate, which makes the moments cost several times as much.
    """
    out = []
    for c in channels:
        out += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"),
            F.skewness(c).alias(f"{c}_skew"), F.kurtosis(c).alias(f"{c}_kurt"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_energy"),
        ]
    d = trace.groupBy(*WELL).agg(F.count(F.lit(1)).alias("n_scans"), *out, *more)
    names = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    values = trace.groupBy(*[F.col(w).alias(f"_{w}") for w in WELL]).agg(*[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_{c}") for c in channels])
    q = values.select(*[f"_{w}" for w in WELL], *[_sorted_percentile(f"_{c}", share).alias(f"{c}_{n}") for c in channels for n, share in names.items()])
    same = reduce(and_, [F.col(w).eqNullSafe(F.col(f"_{w}")) for w in WELL])
    return d.join(q, same).drop(*[f"_{w}" for w in WELL])


def _sorted_percentile(values: str, share: float) -> Column:
    """The percentile of a sorted array, by the arithmetic of Spark's own; null for an empty one."""
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(at), F.ceil(at)
    below, above = F.get(values, low.cast("int")), F.get(values, high.cast("int"))
    return F.when(below == above, below).otherwise((high - at) * below + (at - low) * above)


def correlation_columns(channels: list[str] = CHANNELS, least: int = 50) -> list[Column]:
    """Aggregates of a well: Pearson correlation of all channel pairs; 0 for a constant channel, or for ``least`` scans or fewer."""
    return [F.when(F.count(F.lit(1)) > least, F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))).otherwise(0.0).alias(f"corr_{a}_{b}") for a, b in combinations(channels, 2)]


def correlations(trace: DataFrame, channels: list[str] = CHANNELS, low: int | None = None, high: int | None = None, least: int = 50) -> DataFrame:
    """Pearson correlation of all channel pairs by well, see ``correlation_columns``; of a region's scans if ``low`` and ``high`` are given."""
    d = trace if low is None else trace.where((F.col("scan") >= low) & (F.col("scan") < high))
    return d.groupBy(*WELL).agg(*correlation_columns(channels, least))


def peak_stats(peaks: DataFrame) -> DataFrame:
    """Nine figures of a channel's peaks: count, mean, greatest and total height, mean prominence and width, first and last scan, spread."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return peaks.groupBy(*WELL, "channel").agg(
        F.count(F.lit(1)).alias("n_peaks"), z(F.avg("height")).alias("mean_height"), z(F.max("height")).alias("max_height"), z(F.sum("height")).alias("sum_height"),
        z(F.avg("prominence")).alias("mean_prominence"), z(F.avg("width")).alias("mean_width"), F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), (F.max("scan") - F.min("scan")).alias("spread"),
    )


def standard_features(matched: DataFrame, n: int = 4) -> DataFrame:
    """Places, gaps and heights of up to ``n`` standard peaks of a well; wells with fewer than two have none."""
    d = matched.groupBy(*WELL).agg(F.array_sort(F.collect_list(F.struct("scan", "height"))).alias("p")).where(F.size("p") >= 2)
    at = lambda i, f: F.coalesce(F.try_element_at("p", F.lit(i + 1))[f].cast("double"), F.lit(0.0))
    gaps = {f"is_gap_{i}": F.when(F.size("p") > i, at(i, "scan") - at(i - 1, "scan")).otherwise(0.0) for i in range(1, n)}
    span = F.element_at("p", -1)["scan"] - F.element_at("p", 1)["scan"]
    columns = {"is_count": F.size("p").cast("double"), "is_span": span.cast("double")} | {f"is_scan_{i + 1}": at(i, "scan") for i in range(n)} | {f"is_height_{i + 1}": at(i, "height") for i in range(n)} | gaps
    return d.select(*WELL, *[c.alias(name) for name, c in columns.items()])


def _noise(y: np.ndarray, head: int) -> float:
    """Deviation of a trace's head, or of all of a trace no longer than that."""
    return float((y[:head] if len(y) > head else y).std())


def _by_noise(least: float, head: int) -> Callable[[np.ndarray], dict]:
    """Peaks over three times the noise and a least height, half of that in prominence."""

    def settings(y: np.ndarray) -> dict:
        height = max(least, 3 * _noise(y, head))
        return {"height": height, "prominence": height / 2, "distance": 5, "width": 1}

    return settings


def trace_peak_stats(long: DataFrame) -> DataFrame:
    """``peak_stats`` of the peaks over max(50, 3 noise) of whole traces; a channel without peaks has zeros."""
    d = peak_stats(pk.found_peaks(long, _by_noise(50, NOISE_SCANS)))
    return long.select(*WELL, "channel").distinct().join(d, [*WELL, "channel"], "left").fillna(0)


def region_features(long: DataFrame, low: int = FEATURE_REGION[0], high: int = FEATURE_REGION[1], least: int = 50) -> DataFrame:
    """Level and peaks of each channel in [low, high): mean, deviation, greatest, energy, and count, mean and greatest height, mean prominence and width of peaks over max(20, 3 noise).

    Traces with ``least`` scans or fewer there have zeros.
    """
    inside = long.where((F.col("scan") >= low) & (F.col("scan") < high)).withColumn("_n", F.count(F.lit(1)).over(st.whole("channel"))).where(F.col("_n") > least).drop("_n")
    level = inside.groupBy(*WELL, "channel").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.max("y").alias("max"), F.sum(F.col("y") * F.col("y")).alias("energy"))
    tops = peak_stats(pk.found_peaks(inside, _by_noise(20, 100))).drop("sum_height", "first_scan", "last_scan", "spread")
    return long.select(*WELL, "channel").distinct().join(level, [*WELL, "channel"], "left").join(tops, [*WELL, "channel"], "left").fillna(0)


def automatic_standards(trace: DataFrame, standard: str = "c3", other: str = "c2") -> DataFrame:
    """Standard peaks found without help (plate, well, scan, height, ratio): over 10 noise, 5 noise in prominence, 15 scans apart, 3 wide, and over twice the other channel, which counts only above 10."""

    def settings(y: np.ndarray) -> dict:
        noise = _noise(y, NOISE_SCANS)
        return {"height": 10 * noise, "prominence": 5 * noise, "distance": 15, "width": 3}

    head = F.stddev_pop(F.when(F.col("scan") < NOISE_SCANS, F.col(standard)))
    noise = trace.groupBy(*WELL).agg(F.when(F.count(F.lit(1)) > NOISE_SCANS, head).otherwise(F.stddev_pop(standard)).alias("_noise"))
    long = trace.select(*WELL, F.lit(standard).alias("channel"), "scan", F.col(standard).alias("y"))
    d = pk.found_peaks(long, settings).select(*WELL, "scan", "height").join(trace.select(*WELL, "scan", F.col(other).alias("_other")), [*WELL, "scan"]).join(noise, WELL)
    ratio = F.when(F.col("_other") > 10, F.col("height") / F.col("_other")).otherwise(999.0)
    return d.withColumn("ratio", ratio).where((F.col("ratio") > 2) & (F.col("height") > 10 * F.col("_noise"))).select(*WELL, "scan", "height", "ratio")


def standard_figures(wells: DataFrame, standards: DataFrame, n: int = 4) -> DataFrame:
    """Fifteen figures of each well's standard peaks (plate, well, scan, height): count, greatest, total and mean height, first and last scan, spread, and place and height of the first ``n``; zeros where there are none."""
    d = standards.groupBy(*WELL).agg(
        F.count(F.lit(1)).cast("long").alias("is_n_peaks"), F.max("height").alias("is_max_height"), F.sum("height").alias("is_total_height"), F.avg("height").alias("is_mean_height"),
        F.min("scan").alias("is_first_scan"), F.max("scan").alias("is_last_scan"), (F.max("scan") - F.min("scan")).alias("is_spread"), F.array_sort(F.collect_list(F.struct("scan", "height"))).alias("_p"),
    )
    slots = {f"is_peak_{i}_{c}": F.try_element_at("_p", F.lit(i))[c] for i in range(1, n + 1) for c in ("scan", "height")}
    return wells.select(*WELL).distinct().join(d.withColumns(slots).drop("_p"), WELL, "left").fillna(0)


def robust_scale(features: DataFrame, columns: list[str], by: str = "plate") -> DataFrame:
    """(x - median) / max(p75 - p25, 1e-8) of each feature within its plate: exact percentiles by one aggregation, joined back."""
    q = lambda c: F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = features.groupBy(by).agg(*[q(c).alias(f"_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"_{c}")[1]) / F.greatest(F.col(f"_{c}")[2] - F.col(f"_{c}")[0], F.lit(1e-8)) for c in columns}
    return features.join(stats, by).withColumns(scaled).drop(*[f"_{c}" for c in columns])


def mutant_fraction(peaks: DataFrame) -> DataFrame:
    """Mutant share of a well's peak areas and why: none or no area, one, two, three, or the four tallest in scan order."""
    items = F.collect_list(F.struct("height", F.col("scan").cast("double").alias("scan"), F.col("area").cast("double").alias("area")))
    d = peaks.groupBy(*WELL).agg(items.alias("p"))
    d = d.withColumn("n_peaks", F.size("p").cast("long")).withColumn("total", F.aggregate("p", F.lit(0.0), lambda s, x: s + x["area"]))
    # Tallest first, of equals the earlier; then by scan.
    tall = F.slice(F.array_sort(F.transform("p", lambda x: F.struct((-x["height"]).alias("h"), x["scan"].alias("s"), x["area"].alias("a")))), 1, 4)
    four = F.transform(F.array_sort(F.transform(tall, lambda x: F.struct(x["s"].alias("s"), x["a"].alias("a")))), lambda x: x["a"])
    by_area = F.reverse(F.array_sort(F.transform("p", lambda x: x["area"])))
    d = d.withColumns({"f": four, "a": by_area})
    a = lambda i: F.get("a", F.lit(i))
    f = lambda i: F.get("f", F.lit(i))
    share = a(1) / F.col("total")
    mf = (
        F.when((F.col("n_peaks") == 0) | (F.col("total") <= 0), 0.0).when(F.col("n_peaks") == 1, 0.0)
        .when(F.col("n_peaks") == 2, F.when(share < 0.2, 0.0).otherwise(share))
        .when(F.col("n_peaks") == 3, (a(1) + a(2)) / F.col("total"))
        .otherwise(F.least(f(0) + f(1), f(2) + f(3)) / (f(0) + f(1) + f(2) + f(3)))
    )
    status = F.when((F.col("n_peaks") == 0) | (F.col("total") <= 0), "no signal").when(F.col("n_peaks") == 1, "homoduplex").when(F.col("n_peaks") < 4, "partial").otherwise("heteroduplex")
    return d.select(*WELL, "n_peaks", mf.alias("mf"), status.alias("status"))


def quality_grade(n_standards: Column, standard_fwhm: Column, sample_fwhm: Column) -> Column:
    """A plate's grade from standards per well and median half widths."""
    return F.when(n_standards < 2.5, "FAILED").when((standard_fwhm < 10) & (sample_fwhm < 12), "GOOD").when((standard_fwhm < 15) & (sample_fwhm < 18), "FAIR").otherwise("POOR")


FWHM_LIMITS = {"FAILED": 10, "GOOD": 10, "FAIR": 15, "POOR": 25}


def plate_name(name: Column) -> Column:
    """A plate's name with its run number padded to two digits."""
    run = F.regexp_extract(name, r"Run(\d+)$", 1)
    return F.when(run == "", name).otherwise(F.concat(F.regexp_replace(name, r"Run\d+$", "Run"), F.lpad(run, 2, "0")))


def match_names(wanted: DataFrame, folders: DataFrame) -> DataFrame:
    """A folder for each wanted plate, the first kind that is found: 0 equal, 1 equal once run numbers are padded, 2 a folder that starts with the
    wanted name, 3 one name inside the other. Of equals the first by name.

    All are joins by key: a name meets the folders' prefixes and, for the last kind, each name the other side's substrings. So no pair of
    names is looked at that doesn't match; a name of n characters has at most n * (n + 1) / 2 keys.
    """
    norm = lambda c: plate_name(F.col(c))
    w, f = wanted.select("wanted", norm("wanted").alias("wn")).distinct(), folders.select("folder", norm("folder").alias("fn")).distinct()
    equal = w.join(f, F.col("wn") == F.col("fn")).withColumn("how", F.when(F.col("wanted") == F.col("folder"), 0).otherwise(1))
    rest = w.join(equal.select("wanted").distinct(), "wanted", "left_anti")
    ends = F.explode(F.sequence(F.lit(1), F.length("folder")))
    starts = f.where(F.length("folder") > 0).withColumn("size", ends).select("folder", "fn", F.expr("left(folder, size)").alias("part"))
    prefixed = rest.join(starts, rest["wn"] == starts["part"]).select("wanted", "wn", "folder", "fn", F.lit(2).alias("how"))
    last = rest.join(prefixed.select("wanted").distinct(), "wanted", "left_anti")

    def parts(d: DataFrame, name: str) -> DataFrame:
        """All substrings of a name, once each."""
        begin = d.where(F.length(name) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(name))))
        cut = begin.withColumn("_n", F.explode(F.sequence(F.lit(1), F.length(name) - F.col("_i") + 1)))
        return cut.withColumn("part", F.substring(F.col(name), F.col("_i"), F.col("_n"))).select(*d.columns, "part").distinct()

    inside = last.join(parts(f, "fn"), F.col("wn") == F.col("part"))
    around = parts(last, "wn").join(f, F.col("part") == F.col("fn")).select("wanted", "wn", "folder", "fn")
    held = inside.select("wanted", "wn", "folder", "fn").unionByName(around).distinct().withColumn("how", F.lit(3))
    order = Window.partitionBy("wanted").orderBy("how", "folder")
    both = equal.unionByName(prefixed).unionByName(held)
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("wanted", "folder", "how")


def confusion(results: DataFrame) -> DataFrame:
    """Counts of (ref, pred), by plate and over all (plate null): two grouping sets of one pass."""
    return results.groupingSets([["plate", "ref", "pred"], ["ref", "pred"]], "plate", "ref", "pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(results: DataFrame) -> DataFrame:
    """Wells, hits and accuracy in percent by plate, and over all (plate null)."""
    ok = F.count_if(F.col("ref") == F.col("pred"))
    return results.rollup("plate").agg(F.count(F.lit(1)).alias("n"), ok.alias("n_ok"), F.round(100 * ok / F.count(F.lit(1)), 2).alias("accuracy"))


def train_forest(features: DataFrame, columns: list[str], label: str, trees: int = 300, depth: int = 12, leaf: int = 3, seed: int = 42) -> RandomForestClassificationModel:
    """A balanced random forest on scaled features: each class weighs as much as any other.

    The rows are worked out once for all passes of the fit, see ``_held``.
    """
    known = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features).select(label, "features")
    with _held(known) as d:
        weights = d.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
        forest = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="_w", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
        return forest.fit(d.join(F.broadcast(weights), label).withColumn("_w", 1.0 / F.col("_c")))


@contextmanager
def _held(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` worked out once and held, in no more parts than the cluster runs tasks at once: each part of a forest's pass sends on the sums of all its nodes."""
    held = rows.persist()
    try:
        held.count()
        yield held.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    finally:
        held.unpersist()


def predict(features: DataFrame, columns: list[str], model: RandomForestClassificationModel) -> DataFrame:
    """Class, its name, confidence (3 places) and probabilities (4 places) of every well."""
    d = model.transform(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(features.na.fill(0.0, columns)))
    p = vector_to_array("probability")
    names = F.create_map(*[F.lit(x) for kv in GENOTYPES.items() for x in kv])
    return d.select(*WELL, F.col("prediction").cast("int").alias("prediction_code"), F.try_element_at(names, F.col("prediction").cast("int")).alias("prediction_name"), F.bround(F.array_max(p), 3).alias("confidence"), F.transform(p, lambda x: F.bround(x, 4)).alias("probabilities"))


def standard_only_calls(features: DataFrame, labels: DataFrame, columns: list[str], least: int = 5, seed: int = 42) -> DataFrame:
    """Calls of all wells from standard features by a forest of 200 trees (depth 8, leaves of 5) trained on the labelled ones (plate, well, label).

    With fewer than ``least`` labels there is nothing to learn: every well is heterozygous, with confidence 0.
    """
    known = features.join(labels.select(*WELL, F.col("label").cast("double").alias("label")), WELL)
    if known.limit(least).count() < least:
        return features.select(*WELL, F.lit(4).alias("prediction_code"), F.lit(GENOTYPES[4]).alias("prediction_name"), F.lit(0.0).alias("confidence"))
    return predict(features, columns, train_forest(known.na.fill(0.0, columns), columns, "label", 200, 8, 5, seed)).drop("probabilities")


def peak_forest(peaks: DataFrame, label: str, columns: tuple[str, ...] = ("scan", "height", "width", "area"), trees: int = 100, folds: int = 3, seed: int = 42) -> tuple[RandomForestClassificationModel, float, float]:
    """A forest that tells peaks apart: trained on four fifths by a hash of the row, with its accuracy on the rest and by cross-validation on the training part.

    The peaks are worked out once for all folds and passes, see ``_held``.
    """
    share = F.pmod(F.xxhash64(*WELL, "channel", "scan", F.lit(seed)), F.lit(5))
    d = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(peaks)
    with _held(d.select(F.col(label).cast("double").alias(label), "features", share.alias("_share"))) as rows:
        train, test = rows.where("_share > 0"), rows.where("_share = 0")
        forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed)
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        cv = CrossValidator(estimator=forest, estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, seed=seed).fit(train)
        return cv.bestModel, judge.evaluate(cv.bestModel.transform(test)), cv.avgMetrics[0]


def gated(predictions: DataFrame, wells: DataFrame, with_standard: DataFrame, with_product: DataFrame) -> DataFrame:
    """Calls of wells that have a standard: the prediction if they are amplified, else FAIL with confidence 0; wells without a standard are left out."""
    usable = wells.select(*WELL).join(with_standard.select(*WELL).distinct(), WELL, "left_semi")
    failed = usable.join(with_product.select(*WELL).distinct(), WELL, "left_anti").select(*WELL, F.lit("FAIL").alias("prediction"), F.lit(0.0).alias("confidence"))
    called = predictions.join(usable, WELL, "left_semi").join(with_product.select(*WELL).distinct(), WELL, "left_semi")
    return called.select(*WELL, F.col("prediction_name").alias("prediction"), "confidence").unionByName(failed)


def match_samples(standards: DataFrame, samples: DataFrame, low: int = 5, high: int = 25) -> DataFrame:
    """For each standard peak in scan order the nearest sample peak not yet used that stands ``low`` to ``high`` scans before it."""

    def run(key: tuple, s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in k.matched_before(s["scan"].tolist(), p["scan"].tolist(), low, high)], columns=[*WELL, "standard_scan", "scan"])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in standards.select(*WELL).schema)
    return by_group(standards.select(*WELL, "scan"), samples.select(*WELL, "scan"), WELL, run, f"{keys}, standard_scan long, scan long")


def walk_spacing(candidates: DataFrame, spacing: list[float], tolerance: float = 30, anchors: int = 20, least: float = 0.7) -> DataFrame:
    """Standard peaks by their expected spacing: from each of the best anchors, walk on and take the best-scored candidate near each expected place.

    ``candidates``: plate, well, scan, score. A walk needs ``least`` of all places; the greatest total of scores less a hundredth of the misses wins, of equals the earliest anchor.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["scan"]).reset_index(drop=True)
        best, best_total = [], -float("inf")
        scan, score = pdf["scan"].to_numpy(), pdf["score"].to_numpy()
        tops = np.lexsort((scan, -score))[:anchors]
        for a in tops[np.argsort(scan[tops], kind="stable")].tolist():
            path, at, total = [a], scan[a], score[a]
            for gap in spacing:
                lo, hi = np.searchsorted(scan, at + gap - tolerance, "left"), np.searchsorted(scan, at + gap + tolerance, "right")
                if lo == hi:
                    break
                j = lo + int(np.argmax(score[lo:hi]))
                path.append(j)
                total += score[j] - 0.01 * abs(scan[j] - (at + gap))
                at = scan[j]
            if len(path) >= least * (len(spacing) + 1) and total > best_total:
                best, best_total = path, total
        out = pdf.loc[best, [*WELL, "scan", "score"]].reset_index(drop=True)
        out["idx"] = range(1, len(out) + 1)
        return out

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.select(*WELL).schema)
    return candidates.select(*WELL, F.col("scan").cast("double"), F.col("score").cast("double")).groupBy(*WELL).applyInPandas(run, f"{keys}, scan double, score double, idx long")


def spike_free(long: DataFrame, peaks: DataFrame, least: float = 2.5) -> DataFrame:
    """Peaks whose half-height width is at least ``least``."""

    def run(key: tuple, trace: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        trace, found = trace.sort_values("scan"), found.sort_values("scan")
        scan, y = trace["scan"].to_numpy(), trace["y"].to_numpy(float)
        at = pd.Series(range(len(scan)), index=scan).reindex(found["scan"]).to_numpy(int) if len(found) and len(scan) else []
        wide = k.widths(y, at, 0.5)[0] if len(at) else []
        return found.assign(fwhm=wide)[[*WELL, "channel", "scan", "height", "fwhm"]]

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*WELL, "channel").schema)
    by = [*WELL, "channel"]
    right = peaks.select(*by, "scan", "height")
    return by_group(long.select(*by, "scan", "y"), right, by, run, f"{keys}, scan long, height double, fwhm double").where(F.col("fwhm") >= least)
