"""Queries of training windows, standard peaks by classifier, whole plates and dispatch by chemistry."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basecall as bc
from ..operators import genotype as gt
from ..operators import learning as ln
from ..operators import peaks as pk
from ..operators import signal as sg
from ..operators import standards as sd
from ..operators import training as tn
from ..schema import CHANNELS, WELL
from ..sources import sinks
from ..sources import tables as tb
from . import views as v
from .planted import planted_labels, planted_plate
from .peak_queries import _candidates
from .views import PK, RF, SM, TR, lg, sql

RADIUS = 15


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Calls beside the maxima of one channel: base by quantity, quality by price, up to three scans off."""
    at = v.peaks(spark, sf).select(*WELL, "scan").join(v.trace(spark, sf), [*WELL, "scan"])
    base = F.element_at(F.array(*[F.lit(b) for b in "ACGTN"]), (F.col("current").cast("int") % 5 + 1))
    return at.select(*WELL, (F.col("scan") + F.col("scan") % 4).cast("double").alias("position"), base.alias("base"), F.floor(F.col("c1") / 4000).cast("double").alias("quality"))


def _digest(windows: DataFrame, *keys: str) -> DataFrame:
    total = F.round(F.aggregate("x_c1", F.lit(0.0), lambda s, x: s + x), 2)
    return windows.select(*WELL, *keys, "position", "label", "quality", F.get("x_c1", F.lit(RADIUS)).alias("mid"), total.alias("total"))


def good_calls(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-6."""
    return tn.good_calls(_labelled(spark, sf), 10)


def training_windows(spark: SparkSession, sf: str) -> DataFrame:
    """DP-1: windows of 31 around all calls, by their middle and sum."""
    return _digest(tn.training_windows(v.trace(spark, sf), _labelled(spark, sf), RADIUS, ["c1"]))


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return tn.matched_calls(_labelled(spark, sf), v.peaks(spark, sf, ("c3",)), 2)


def matched_windows(spark: SparkSession, sf: str) -> DataFrame:
    """DP-2: windows around the detected peaks nearest to the calls."""
    return _digest(tn.matched_windows(v.trace(spark, sf), _labelled(spark, sf), v.peaks(spark, sf, ("c3",)), RADIUS, 2, ["c1"]))


def match_stats(spark: SparkSession, sf: str) -> DataFrame:
    """DP-2: matched and unmatched calls and their offsets, by well."""
    return tn.match_stats(_matched(spark, sf)).withColumns({c: F.round(c, 6) for c in ("avg_offset", "std_offset")})


def extraction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """DP-4: windows of two variants (as called, and matched) by label, each and together."""
    trace, calls = v.trace(spark, sf), _labelled(spark, sf)
    near = tn.moved_calls(calls, v.peaks(spark, sf, ("c3",)), 2)
    return tn.extraction_counts(tn.training_windows(trace, tn.named_variants({"called": calls, "matched": near}), RADIUS, ["c1"]))


def shift_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """DP-10: a scorer by the middle's z-scores, on windows moved by -4, -2, 2 and 4 scans; sequential in its scorer, tested on hand vectors."""

    def scorer(x: np.ndarray) -> np.ndarray:
        e = np.exp(x[:, x.shape[1] // 2, :])
        return e / e.sum(axis=1, keepdims=True)

    d = tn.shift_accuracy(tn.training_windows(v.trace(spark, sf), _labelled(spark, sf), RADIUS), scorer)
    return d.withColumn("accuracy", F.round("accuracy", 6))


def greedy_references(spark: SparkSession, sf: str) -> DataFrame:
    """IS-8: references take the nearest free peak of two channels within 150, in their order."""
    return sd.greedy_references(v.references(spark, sf), v.peaks(spark, sf, ("c2", "c3")))


def spread_references(spark: SparkSession, sf: str) -> DataFrame:
    """IS-5: farthest spread candidates; sequential, tested on hand vectors."""
    return sd.farthest_spread(_candidates(spark, sf))


def plate_references(spark: SparkSession, sf: str) -> DataFrame:
    """GT-21: a plate's own references, else those set by hand; tested on hand vectors."""
    return sd.plate_references(_candidates(spark, sf), v.references(spark, sf))


def _candidate_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Maxima of the standard channel over three times the noise."""
    noise = sg.noise_level(v.long(spark, sf, ("c3",)))
    return v.peaks(spark, sf, ("c3",)).join(noise, pk.BY_CHANNEL).where(F.col("height") > 3 * F.col("noise")).select(*WELL, "scan")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Marked standard peaks: the four tallest maxima of each well's standard channel."""
    return pk.top_peaks(v.peaks(spark, sf, ("c3",)), 4).select(*WELL, "scan")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    noise = sg.noise_level(v.long(spark, sf, ("c3",))).select(*WELL, "noise")
    return sd.peak_features(v.trace(spark, sf), noise)


def standard_examples(spark: SparkSession, sf: str) -> DataFrame:
    """IS-10: what the classifier of standard peaks learns from."""
    d = sd.standard_examples(_features(spark, sf), v.peaks(spark, sf, ("c3",)).select(*WELL, "scan"), _marked(spark, sf))
    return d.select(*WELL, "scan", "label", F.round("snr", 4).alias("snr"))


def _forest(examples: DataFrame) -> tuple[RandomForestClassificationModel, list[str]]:
    columns = [c for c in examples.columns if c not in (*WELL, "scan", "label")]
    return gt.train_forest(examples, columns, "label", 300, 8, 1), columns


def standard_calls(spark: SparkSession, sf: str) -> DataFrame:
    """IS-10 and IS-13: a balanced forest of 300 trees scores all candidates; each well's best four; statistical."""
    features, candidates = _features(spark, sf).na.fill(0.0), v.peaks(spark, sf, ("c3",)).select(*WELL, "scan")
    model, columns = _forest(sd.standard_examples(features, candidates, _marked(spark, sf)))
    d = VectorAssembler(inputCols=columns, outputCol="features").transform(features.join(candidates, [*WELL, "scan"]))
    scored = model.transform(d).select(*WELL, "scan", vector_to_array("probability")[1].alias("score"))
    return sd.best_scored(scored)


def standard_only_calls(spark: SparkSession, sf: str) -> DataFrame:
    """GT-9: calls of planted wells from the standard's features alone, learned from half of them; statistical, held to beat the majority."""
    d = planted_plate(spark, sf)
    f = gt.standard_features(pk.top_peaks(pk.local_maxima(sg.to_long(d, ["c3"])), 4))
    known = planted_labels(d).withColumn("known", F.pmod(F.xxhash64("well", F.lit(5)), F.lit(2)) == 0)
    calls = gt.standard_only_calls(f, known.where("known").select(*WELL, F.col("code").alias("label")), [c for c in f.columns if c not in WELL])
    return calls.join(known.select(*WELL, "known", F.col("code").alias("label")), WELL)


def peak_forest(spark: SparkSession, sf: str) -> DataFrame:
    """GT-23: a forest that tells the channels of detected peaks apart, and its accuracies; statistical."""
    d = pk.detect_default(v.long(spark, sf, ("c1", "c2"))).withColumn("label", F.when(F.col("channel") == "c1", 0.0).otherwise(1.0))
    model, held_out, folds = gt.peak_forest(d, "label")
    return spark.createDataFrame([(model.getNumTrees, float(held_out), float(folds))], "trees int, held_out double, cross_validated double")


def calls_by_chemistry(spark: SparkSession, sf: str) -> DataFrame:
    """BC-17 and BC-7: each chemistry and caller variant by name, its calls counted by base; sequential in its peaks, tested on hand vectors."""
    names = ("ET Terminators", "TSII-v2", "Cimarron 3.12", "Cimarron 3.12 and Aligned", "Cimarron 3.12 Even Spacing")
    trace = v.trace(spark, sf)
    found = pk.detect_for_bases(trace).persist()  # sought once for all callers
    d = [bc.call_bases(trace, n, detect=lambda _: found).groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality")).withColumn("chemistry", F.lit(n)) for n in names]
    out = d[0]
    for more in d[1:]:
        out = out.unionByName(more)
    return out.select("chemistry", "base", "n", "quality")


def scatter_matrices(spark: SparkSession, sf: str) -> DataFrame:
    """MX-6: within- and between-class scatter, what the discriminants are made of."""
    d = tn.discriminant_sums(v.samples(spark, sf), "base")
    return d.select(*[F.round(c, 4).alias(c) for c in d.columns])


def discriminants(spark: SparkSession, sf: str) -> DataFrame:
    """MX-6: directions of linear discriminant analysis; tested against a plain form."""
    m = ln.discriminants(v.samples(spark, sf), "base", CHANNELS, 3)
    return spark.createDataFrame([(i, *map(float, m[:, i])) for i in range(m.shape[1])], "nth int, c1 double, c2 double, c3 double, c4 double")


def prefix_plates(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9: wells of the plates whose name starts with I."""
    n = v.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("plate"))
    s = v.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("key"), F.col("s_suppkey").alias("well"))
    return tb.plates_like(n.join(s, "key").select("plate", "well"), "I")


def picked_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """PK-19: the peak nearest to each clicked place, nearer than 10."""
    clicks = v.references(spark, sf).join(v.trace(spark, sf).select(*WELL).distinct(), "plate").select(*WELL, F.col("ref_scan").alias("at"))
    return pk.picked(clicks, v.peaks(spark, sf), 10).select(*WELL, "at", "scan", "height")


def added_channels(spark: SparkSession, sf: str) -> DataFrame:
    """PK-20: the channel of the greatest sample at each scan, counted by well."""
    return pk.channel_of_greatest(v.trace(spark, sf)).groupBy(*WELL, "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("scan").alias("sum_scan"))


def dense_standards(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-7: four standard peaks of a well in one row."""
    d = pk.top_peaks(v.peaks(spark, sf, ("c3",)), 4)
    idx = d.select(F.col("plate").alias("folder"), "well", "scan", F.round("height", 4).alias("height"))
    from pyspark.sql.window import Window

    return sinks.dense_standards(idx.withColumn("is_idx", F.row_number().over(Window.partitionBy("folder", "well").orderBy("scan"))))


CL = "cl AS (SELECT pk.plate, pk.well, CAST(pk.scan + pk.scan % 4 AS DOUBLE) AS position, substr('ACGTN', CAST(CAST(current AS INTEGER) % 5 + 1 AS INTEGER), 1) AS base, CAST(floor(c1 / 4000) AS DOUBLE) AS quality FROM pk JOIN tr USING (plate, well, scan) WHERE pk.channel = 'c1')"
WN = f"wn AS (SELECT plate, well, scan AS position, c1 AS mid, round(sum(c1) OVER f, 2) AS total, count(*) OVER (PARTITION BY plate, well) AS n FROM tr WINDOW f AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN {RADIUS} PRECEDING AND {RADIUS} FOLLOWING))"
LABEL = "CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END"
MC = "mc AS (SELECT plate, well, base, quality, called, peak, coalesce(peak, called) AS position FROM (SELECT cl.*, CAST(position AS BIGINT) AS called, (SELECT arg_min(p.scan, (abs(p.scan - cl.position), p.scan)) FROM pk p WHERE p.channel = 'c3' AND p.plate = cl.plate AND p.well = cl.well AND abs(p.scan - cl.position) <= 2) AS peak FROM cl))"
INSIDE = f"position >= {RADIUS} AND position < n - {RADIUS}"
BASES = [TR, lg("c1", "c3"), PK, CL]
TOP4 = "t4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY height DESC, scan) AS k FROM pk) WHERE k <= 4)"


def _greedy_sql() -> str:
    """The references of ``RF`` one after another, each without the peaks that earlier ones took."""
    steps = ["pc AS (SELECT DISTINCT plate, well, scan FROM pk)"]
    for i in range(1, 5):
        taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM g{j} WHERE g{j}.plate = pc.plate AND g{j}.well = pc.well AND g{j}.scan = pc.scan)" for j in range(1, i))
        steps.append(
            f"g{i} AS (SELECT plate, well, ref_idx, ref_scan, scan FROM (SELECT pc.*, ref_idx, ref_scan, row_number() OVER (PARTITION BY pc.plate, pc.well ORDER BY abs(scan - ref_scan), scan) AS k "
            f"FROM pc JOIN rf ON rf.plate = pc.plate AND ref_idx = {i} AND abs(scan - ref_scan) <= 150{taken}) WHERE k = 1)"
        )
    return sql(" UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(1, 5)), TR, lg("c2", "c3"), PK, RF, *steps)


PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
SCATTER = "SELECT " + ", ".join([f"round(sum(p{i}_{j}) - sum(s{i} * s{j} / n), 4) AS w_{i}_{j}" for i, j in PAIRS] + [f"round(sum(s{i} * s{j} / n) - sum(s{i}) * sum(s{j}) / sum(n), 4) AS b_{i}_{j}" for i, j in PAIRS])
SCATTER += " FROM (SELECT base, count(*) AS n, " + ", ".join([f"sum(c{i + 1}) AS s{i}" for i in range(4)] + [f"sum(c{i + 1} * c{j + 1}) AS p{i}_{j}" for i, j in PAIRS]) + " FROM sm GROUP BY base)"

QUERIES: v.Queries = {
    "good_calls": (good_calls, sql("SELECT * FROM cl WHERE quality >= 10 AND base <> 'N'", *BASES)),
    "training_windows": (training_windows, sql(f"SELECT plate, well, wn.position, CAST({LABEL} AS INTEGER) AS label, quality, mid, total FROM cl JOIN wn USING (plate, well, position) WHERE {INSIDE}", *BASES, WN)),
    "matched_windows": (matched_windows, sql(f"SELECT plate, well, wn.position, CAST({LABEL} AS INTEGER) AS label, quality, mid, total FROM mc JOIN wn USING (plate, well, position) WHERE {INSIDE}", *BASES, MC, WN)),
    "match_stats": (match_stats, sql("SELECT plate, well, count(peak) AS matched, count(*) - count(peak) AS unmatched, round(coalesce(avg(peak - called), 0), 6) AS avg_offset, round(coalesce(stddev_pop(peak - called), 0), 6) AS std_offset FROM mc GROUP BY ALL", *BASES, MC)),
    "extraction_counts": (extraction_counts, sql("SELECT variant, label, count(*) AS n FROM ex GROUP BY ALL UNION ALL SELECT NULL, label, count(*) FROM ex GROUP BY label", *BASES, MC, WN, f"ex AS (SELECT 'called' AS variant, CAST({LABEL} AS INTEGER) AS label FROM cl JOIN wn USING (plate, well, position) WHERE {INSIDE} UNION ALL SELECT 'matched', CAST({LABEL} AS INTEGER) FROM mc JOIN wn USING (plate, well, position) WHERE {INSIDE})")),
    "shift_accuracy": (shift_accuracy, None),
    "greedy_references": (greedy_references, _greedy_sql()),
    "spread_references": (spread_references, None),
    "plate_references": (plate_references, None),
    "standard_examples": (standard_examples, sql("SELECT plate, well, scan, label, round(c3 / (noise + 1), 4) AS snr FROM (SELECT plate, well, scan, 1.0::DOUBLE AS label FROM t4 JOIN us USING (plate, well) UNION ALL SELECT plate, well, scan, 0.0 FROM (SELECT pk.plate, pk.well, pk.scan, row_number() OVER (PARTITION BY pk.plate, pk.well ORDER BY pk.scan) AS k FROM pk JOIN us USING (plate, well) ANTI JOIN t4 USING (plate, well, scan)) WHERE k <= 8) JOIN tr USING (plate, well, scan) JOIN nl USING (plate, well)", TR, lg("c3"), PK, TOP4, "us AS (SELECT plate, well FROM t4 GROUP BY ALL HAVING count(*) = 4)", "nl AS (SELECT plate, well, CASE WHEN count(*) > 200 THEN greatest(stddev_pop(y) FILTER (WHERE scan < 200), 1e-10) ELSE greatest(stddev_pop(y), 1.0) END AS noise FROM lg GROUP BY ALL)")),
    "standard_calls": (standard_calls, None),
    "standard_only_calls": (standard_only_calls, None),
    "peak_forest": (peak_forest, None),
    "calls_by_chemistry": (calls_by_chemistry, None),
    "scatter_matrices": (scatter_matrices, sql(SCATTER, SM)),
    "discriminants": (discriminants, None),
    "prefix_plates": (prefix_plates, "SELECT n_name AS plate, s_suppkey AS well FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE starts_with(n_name, 'I')"),
    "picked_peaks": (picked_peaks, sql("SELECT plate, well, ref_scan AS at, scan, height FROM (SELECT pk.*, ref_scan, row_number() OVER (PARTITION BY pk.plate, pk.well, ref_scan ORDER BY abs(scan - ref_scan), scan) AS k FROM pk JOIN rf ON rf.plate = pk.plate AND abs(scan - ref_scan) < 10) WHERE k = 1", TR, lg("c1"), PK, RF)),
    "added_channels": (added_channels, sql("SELECT plate, well, channel, count(*) AS n, CAST(sum(scan) AS BIGINT) AS sum_scan FROM (SELECT *, CASE WHEN c1 >= c2 AND c1 >= c3 AND c1 >= c4 THEN 'c1' WHEN c2 >= c3 AND c2 >= c4 THEN 'c2' WHEN c3 >= c4 THEN 'c3' ELSE 'c4' END AS channel FROM tr) GROUP BY ALL", TR)),
    "dense_standards": (dense_standards, sql("SELECT plate AS folder, well, " + ", ".join(f"max(scan) FILTER (WHERE i = {i}) AS is_peak_{i}_scan, max(round(height, 4)) FILTER (WHERE i = {i}) AS is_peak_{i}_height" for i in range(1, 5)) + " FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY scan) AS i FROM t4) GROUP BY ALL", TR, lg("c3"), PK, TOP4)),
}
