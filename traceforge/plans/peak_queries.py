"""Queries of peaks, standards and genotyping."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import genotype as gt
from ..operators import joins as jn
from ..operators import peaks as pk
from ..operators import signal as sg
from ..operators import standards as sd
from ..schema import CHANNELS, WELL
from ..sources import tables as tb
from . import views as v
from .views import PK, RF, TR, lg, sql

C1 = ("c1",)


def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """PK-1 first step, plateaus included."""
    return v.peaks(spark, sf, ("c1", "c2"))


def height_filter_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-11: maxima of at least max(50, 1.2 noise)."""
    d = v.peaks(spark, sf).join(sg.noise_level(v.long(spark, sf, C1)), pk.BY_CHANNEL)
    return d.where(F.col("height") >= F.greatest(F.lit(50.0), 1.2 * F.col("noise"))).select(*WELL, "channel", "scan", "height")


def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-1 and FLT-2: peaks in a closed scan range, of maxima of the half-open region 100 to 500."""
    region = v.long(spark, sf, C1).where((F.col("scan") >= 100) & (F.col("scan") < 500))
    return pk.local_maxima(region).where(F.col("scan").between(150, 300))


def relative_height(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-8."""
    return pk.relative_height(v.peaks(spark, sf), 0.8)


def long_wells(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-3: wells of at least 550 scans, with their length."""
    return pk.cut_short_wells(v.trace(spark, sf), 550).groupBy(*WELL).agg(F.count(F.lit(1)).alias("n"))


def fwhm_walk(spark: SparkSession, sf: str) -> DataFrame:
    """PK-12 on all maxima."""
    return pk.half_width(v.long(spark, sf, C1), v.peaks(spark, sf))


def stutter_group(spark: SparkSession, sf: str) -> DataFrame:
    """PK-4, window 5."""
    return pk.stutter_groups(v.peaks(spark, sf), 5)


def threshold_groups(spark: SparkSession, sf: str) -> DataFrame:
    """PK-8."""
    return pk.threshold_groups(v.long(spark, sf, ("c1", "c2")), 0.5, 3).withColumn("area", F.round("area", 2))


def refine_noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    """PK-10 and FLT-8: doublets merged by a fold with a moving anchor."""
    return pk.refine(pk.threshold_groups(v.long(spark, sf, C1), 0.5, 3), 12, 0.9).withColumn("area", F.round("area", 2))


def top_n_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """PK-14."""
    return pk.top_peaks(v.peaks(spark, sf), 4)


def primer_removal(spark: SparkSession, sf: str) -> DataFrame:
    """PK-15 on the four tallest peaks."""
    return pk.without_primer(pk.top_peaks(v.peaks(spark, sf), 4), 30)


def peak_area_window(spark: SparkSession, sf: str) -> DataFrame:
    """PK-7: trapezoid areas of +-5 scans at the peaks."""
    areas = pk.window_areas(v.long(spark, sf, C1), 5).select(*pk.BY_CHANNEL, "scan", F.round("area", 3).alias("area"))
    return v.peaks(spark, sf).join(areas, [*pk.BY_CHANNEL, "scan"])


def is_filter_topn(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-12."""
    return pk.standard_display_filter(v.peaks(spark, sf, ("c1", "c2")), "c1", 4)


def is_area_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """IS-17."""
    areas = pk.window_areas(v.long(spark, sf, ("c1", "c2")), 5).select(*pk.BY_CHANNEL, "scan", "area")
    d = sd.area_ratio(v.peaks(spark, sf, ("c1", "c2")).join(areas, [*pk.BY_CHANNEL, "scan"]), "c1", 3)
    return d.withColumn("ratio", F.round("ratio", 4))


def _edits(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as an edit log: errors delete the user's scan of that number, purchases add one."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "add")
    d = v.table(spark, sf, "events").select("user_id", op.alias("op"), (F.col("event_id") % 500).alias("scan")).where("op IS NOT NULL")
    wells = v.trace(spark, sf).select(*WELL).distinct()
    return d.join(wells, d["user_id"] == wells["well"]).select(*WELL, "op", "scan", F.lit("c1").alias("channel"))


def peak_edits_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """PK-18."""
    return pk.with_edits(v.peaks(spark, sf), _edits(spark, sf))


def clear_all(spark: SparkSession, sf: str) -> DataFrame:
    """PK-22: every peak of a plate's first well deleted by its scan; the peaks that are left of each well."""
    peaks = v.peaks(spark, sf)
    first = F.min("well").over(Window.partitionBy("plate"))
    gone = peaks.withColumn("_f", first).where("well = _f").select(*WELL, "scan", F.lit("delete").alias("op"), "channel")
    return pk.with_edits(peaks, gone).groupBy(*WELL).agg(F.count(F.lit(1)).alias("n_left"))


def nearest_is_match(spark: SparkSession, sf: str) -> DataFrame:
    """IS-6."""
    tall = v.peaks(spark, sf, ("c3",)).select(*WELL, "scan", F.round("height", 4).alias("height"))
    return sd.match_references(v.references(spark, sf), tall, 50)


def is_raw_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """IS-7."""
    d = sd.greatest_near_references(v.trace(spark, sf), v.references(spark, sf), "c3", 80, 80, factor=2)
    return d.withColumn("height", F.round("height", 4))


def is_quality(spark: SparkSession, sf: str) -> DataFrame:
    """IS-2."""
    return sd.quality(v.trace(spark, sf)).select(*WELL, "scan", F.round("quality", 6).alias("quality"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    q = sd.quality(v.trace(spark, sf)).select(*WELL, "scan", "quality")
    tall = v.peaks(spark, sf, ("c3",)).join(q, [*WELL, "scan"])
    return sd.consistent_candidates(tall, first_scan=20, most=40, within=25, share=0.3, spread=15)


def is_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """IS-1: reference candidates that a plate's wells agree on."""
    return _candidates(spark, sf).withColumns({c: F.round(c, 3) for c in ("std_scan", "score")})


def is_combo_search(spark: SparkSession, sf: str) -> DataFrame:
    """IS-3 and IS-4: the best four of each plate's tallest peaks, by score of spread and spacing."""
    order = Window.partitionBy("plate").orderBy(F.desc("height"), "scan", "well")
    tall = v.peaks(spark, sf).groupBy("plate", "scan").agg(F.max("height").alias("height"), F.min("well").alias("well")).withColumn("k", F.row_number().over(order)).where("k <= 40")
    return sd.best_four(tall.select("plate", "scan", F.round(F.col("height") / 1000, 3).alias("score")), ["plate"]).select("plate", "p1", "p2", "p3", "p4", "total")


def is_features(spark: SparkSession, sf: str) -> DataFrame:
    """IS-9: peak features of every scan."""
    noise = sg.noise_level(v.long(spark, sf, ("c3",))).select(*WELL, "noise")
    d = sd.peak_features(v.trace(spark, sf), noise)
    return d.select(*WELL, "scan", *[F.round(c, 4).alias(c) for c in d.columns if c not in (*WELL, "scan")])


def is_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """IS-12."""
    return sd.spacing(pk.top_peaks(v.peaks(spark, sf, ("c3",)), 6))


def amplification_semi(spark: SparkSession, sf: str) -> DataFrame:
    """IS-15: wells with a product peak, of at least 98 % of the well's tallest, shortly before a reference."""
    refs = v.references(spark, sf).join(v.trace(spark, sf).select(*WELL).distinct(), "plate").select(*WELL, "ref_scan")
    return sd.amplified(refs, pk.relative_height(v.peaks(spark, sf, ("c1", "c2")), 0.98), 30, 1)


def background_anti(spark: SparkSession, sf: str) -> DataFrame:
    """DP-3: scans clear of all peaks of at least 98 % of the tallest, counted by well."""
    from ..operators.learning import background

    d = background(v.trace(spark, sf), pk.relative_height(v.peaks(spark, sf), 0.98), 15, 5, 1 << 30)
    return d.groupBy(*WELL).agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.sum("position").alias("sum_position"))


def sample_is_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """PK-17 without exclusivity: each standard's nearest sample 5 to 25 scans before it."""
    std = pk.top_peaks(v.peaks(spark, sf, ("c3",)), 4).select(*WELL, F.col("scan").alias("standard_scan"))
    smp = v.peaks(spark, sf, ("c2",)).select(*WELL, "scan")
    d = jn.range_join(std, smp, WELL, "scan", F.col("standard_scan") - 25, F.col("standard_scan") - 5, 20)
    return d.groupBy(*WELL, "standard_scan").agg(F.max("scan").alias("scan"), F.count(F.lit(1)).alias("n_inside"))


def match_samples(spark: SparkSession, sf: str) -> DataFrame:
    """PK-17, greedy."""
    std, smp = pk.top_peaks(v.peaks(spark, sf, ("c3",)), 4), v.peaks(spark, sf, ("c2",))
    return gt.match_samples(std, smp)


def background_range_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Anti join by range: c1 peaks with no c3 peak of at least 90 % of the tallest within 10 scans."""
    a = v.peaks(spark, sf).select(*WELL, "scan", "height")
    b = pk.relative_height(v.peaks(spark, sf, ("c3",)), 0.9).select(*WELL, F.col("scan").alias("other"))
    return jn.range_join(a, b, WELL, "other", F.col("scan") - 10, F.col("scan") + 10, 20, "left_anti", [*WELL, "scan"])


def gene_ref_containment(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: regions as genes, their nations' names carrying them as plates."""
    nation, region = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    plates = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat_ws("_", "n_name", "r_name", F.lit("Run1")).alias("plate"))
    refs = region.select(F.col("r_name").alias("gene"), F.lit(1).alias("ref_idx"), (F.col("r_regionkey") * 100).cast("long").alias("ref_scan"))
    short = region.select(F.substring("r_name", 1, 2).alias("gene"), F.lit(1).alias("ref_idx"), (F.col("r_regionkey") * 7).cast("long").alias("ref_scan"))
    return tb.references_for(plates, refs.unionByName(short)).select("plate", "gene", "ref_scan")


def fuzzy_plate_match(spark: SparkSession, sf: str) -> DataFrame:
    """GT-19 and GT-20: nation names with a run, matched to folders of another spelling."""
    n = v.table(spark, sf, "nation")
    run = (F.col("n_nationkey") % 4).cast("int").cast("string")
    wanted = n.select(F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.substring("n_name", 2, 4), F.lit("_"))).otherwise(F.concat("n_name", F.lit("_Run"), run)).alias("wanted"))
    way = F.col("n_nationkey") % 6
    folder = (
        F.when(way == 0, F.concat("n_name", F.lit("_Run0"), run)).when(way == 1, F.concat("n_name", F.lit("_Run"), run)).when(way == 2, F.concat("n_name", F.lit("_Run0"), run, F.lit("_b")))
        .when(way == 3, F.concat(F.lit("x"), "n_name", F.lit("_Run0"), run)).when(way == 4, F.substring("n_name", 1, 5)).otherwise(F.concat("n_name", F.lit("_160910Run"), run))
    )
    return gt.match_names(wanted, n.select(folder.alias("folder")))


def trace_stats(spark: SparkSession, sf: str) -> DataFrame:
    """GT-1."""
    d = gt.trace_stats(v.trace(spark, sf), ["c1", "c2"])
    return d.select(*WELL, "n_scans", *[F.round(c, 0 if c.endswith("energy") else 2 if c.endswith(("mean", "std")) else 4 if c.endswith(("p25", "median", "p75")) else 3).alias(c) for c in d.columns if c not in (*WELL, "n_scans")])


def region_stats(spark: SparkSession, sf: str) -> DataFrame:
    """GT-3: peak figures of a scan region."""
    region = v.long(spark, sf, ("c1", "c2")).where((F.col("scan") >= 150) & (F.col("scan") < 400))
    d = pk.local_maxima(region).withColumns({"prominence": F.lit(0.0), "width": F.lit(1.0)})
    return gt.peak_stats(d).withColumns({"mean_height": F.round("mean_height", 3), "sum_height": F.round("sum_height", 2)}).drop("mean_prominence", "mean_width")


def channel_corr(spark: SparkSession, sf: str) -> DataFrame:
    """GT-4."""
    d = gt.correlations(v.trace(spark, sf))
    return d.select(*WELL, *[F.round(c, 6).alias(c) for c in d.columns if c.startswith("corr")])


def standard_features(spark: SparkSession, sf: str) -> DataFrame:
    """GT-5 and GT-6: the standard's part of the features."""
    return gt.standard_features(pk.top_peaks(v.peaks(spark, sf), 4))


def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    """GT-7."""
    d = v.trace(spark, sf).groupBy(*WELL).agg(F.round(F.avg("c1"), 6).alias("m"), F.max("c2").alias("x"))
    d = gt.robust_scale(d, ["m", "x"])
    return d.select(*WELL, F.round("m", 4).alias("m"), F.round("x", 4).alias("x"))


def _mf_peaks(spark: SparkSession, sf: str) -> DataFrame:
    tall = v.peaks(spark, sf).withColumn("_t", F.max("height").over(Window.partitionBy(*WELL)))
    return tall.where(F.col("height") >= 0.99 * F.col("_t")).select(*WELL, "scan", "height", F.col("height").alias("area"))


def mutant_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """GT-14."""
    return gt.mutant_fraction(_mf_peaks(spark, sf)).withColumn("mf", F.round("mf", 6))


def plate_summary_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """GT-18: wells with one, four and other numbers of peaks, by plate and over all."""
    d = gt.mutant_fraction(_mf_peaks(spark, sf))
    n = F.col("n_peaks")
    return d.rollup("plate").agg(F.count(F.lit(1)).alias("n_wells"), F.count_if(n == 1).alias("n_one"), F.count_if(n == 4).alias("n_four"), F.count_if(~n.isin(1, 4)).alias("n_other"))


def plate_grade(spark: SparkSession, sf: str) -> DataFrame:
    """GT-16: grade of each plate from its wells' standards and median half widths."""
    tall = pk.top_peaks(v.peaks(spark, sf), 4)
    d = pk.half_width(v.long(spark, sf, C1), tall).groupBy("plate").agg((F.count(F.lit(1)) / F.countDistinct("well")).alias("per_well"), F.percentile("fwhm", F.lit(0.5)).alias("fwhm"))
    return d.select("plate", F.round("per_well", 3).alias("per_well"), "fwhm", gt.quality_grade(F.col("per_well"), F.col("fwhm"), F.col("fwhm")).alias("grade"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``labels`` as calls: quality the truth, toxic the prediction; the document's source the plate."""
    d = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return d.select(F.col("source").alias("plate"), F.col("doc_id").alias("well"), F.col("quality").cast("int").alias("ref"), F.col("toxic").cast("int").alias("pred"))


def prediction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """GT-12 and GT-13: counts of predictions by name."""
    names = F.create_map(F.lit(0), F.lit("fail"), F.lit(1), F.lit("hom1"))
    return _predictions(spark, sf).groupBy(F.try_element_at(names, F.col("pred")).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def validation_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """GT-22: confusion by plate and over all."""
    return gt.confusion(_predictions(spark, sf))


def validation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """GT-22: accuracy by plate and over all."""
    return gt.accuracy(_predictions(spark, sf))


def gated_calls(spark: SparkSession, sf: str) -> DataFrame:
    """GT-11: calls of wells with a standard; FAIL without a product."""
    wells = v.trace(spark, sf).select(*WELL).distinct()
    mf = gt.mutant_fraction(_mf_peaks(spark, sf)).select(*WELL, F.col("status").alias("prediction_name"), F.lit(1.0).alias("confidence"))
    tall = pk.top_peaks(v.peaks(spark, sf, ("c3",)), 3)
    standard = tall.where("height >= 6000")
    return gt.gated(mf, wells, standard, amplification_semi(spark, sf))


def well_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """2.13: union, intersection and difference of well sets."""
    a, b = v.trace(spark, sf).where("c1 > 80000").select("well"), v.trace(spark, sf).where("c2 > 49000 AND scan < 60").select("well")
    tag = lambda d, t: d.select("well", F.lit(t).alias("op"))
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.subtract(b), "except"))


def find_peaks_full(spark: SparkSession, sf: str) -> DataFrame:
    """PK-1, PK-2, PK-3 and PK-6: the detector with all its filters on all channels; sequential, tested on hand vectors."""
    return pk.detect(v.long(spark, sf), height=100, prominence=50, distance=5, width=1, stutter=5)


def nms_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """PK-5."""
    return pk.detect_for_bases(v.trace(spark, sf))


def broad_split(spark: SparkSession, sf: str) -> DataFrame:
    """PK-9."""
    d = v.long(spark, sf, C1)
    return pk.split_broad(d, pk.threshold_groups(d, 0.1, 15), 50, 5)


def gauss_fit(spark: SparkSession, sf: str) -> DataFrame:
    """PK-11: the refined groups over a threshold of a smoothed trace as Gaussians; tolerance only."""
    d = v.long(spark, sf, C1)
    return pk.deconvolve(d, pk.refine(pk.found_groups(d, 0.15, 6, smooth=11), 3, 0.15), smooth=11)


def spike_filter(spark: SparkSession, sf: str) -> DataFrame:
    """PK-13 and PK-16."""
    return gt.spike_free(v.long(spark, sf, C1), v.peaks(spark, sf), 2.5)


def spacing_walk(spark: SparkSession, sf: str) -> DataFrame:
    """IS-11."""
    d = v.peaks(spark, sf, ("c3",)).select(*WELL, "scan", F.col("height").alias("score"))
    return gt.walk_spacing(d, [100.0, 120.0, 100.0])


def forest_calls(spark: SparkSession, sf: str) -> DataFrame:
    """GT-8 and GT-10: a balanced forest of 300 trees on scaled trace features, trained on four fifths of the planted wells; calls of all wells; statistical, held to beat the majority."""
    from ..operators.learning import well_split
    from .planted import planted_features

    f, columns = planted_features(spark, sf)
    f = well_split(gt.robust_scale(f.na.fill(0.0, columns), columns)).withColumn("label", F.col("code").cast("double")).persist()
    called = gt.predict(f, columns, gt.train_forest(f.where("part = 'train'"), columns, "label"))
    return called.join(f.select(*WELL, "part", F.col("label").cast("int").alias("label")), WELL)


TOP = lambda n, name="tp": f"{name} AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY plate, well, channel ORDER BY height DESC, scan) AS k FROM pk) WHERE k <= {n})"
ALL = "tp AS (SELECT * FROM pk)"
HIGH = lambda share: f"tp AS (SELECT * FROM (SELECT *, max(height) OVER (PARTITION BY plate, well) AS t FROM pk) WHERE height >= {share} * t)"
NL = "nl AS (SELECT plate, well, channel, CASE WHEN count(*) > 200 THEN greatest(stddev_pop(y) FILTER (WHERE scan < 200), 1e-10) ELSE greatest(stddev_pop(y), 1.0) END AS noise FROM lg GROUP BY ALL)"
TG = """tb AS (SELECT plate, well, channel, quantile_cont(y, 0.5) FILTER (WHERE scan < 100) AS b, max(y) AS t FROM lg GROUP BY ALL),
ta AS (SELECT lg.*, CASE WHEN scan - lag(scan) OVER w > 3 THEN 1 ELSE 0 END AS cut FROM lg JOIN tb USING (plate, well, channel) WHERE t - b >= 1 AND y > b + (t - b) * 0.5 WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan)),
tc AS (SELECT *, sum(cut) OVER (PARTITION BY plate, well, channel ORDER BY scan) AS g FROM ta),
tg AS (SELECT plate, well, channel, arg_min(scan, (-y, scan)) AS scan, max(y) AS height, min(scan) AS "left", max(scan) AS "right", count(*) AS n_points, sum(y) AS area FROM tc GROUP BY plate, well, channel, g HAVING count(*) >= 2)"""
AREA5 = "wa AS (SELECT plate, well, channel, scan, sum(y) OVER f - (lag(y, 5) OVER w + lead(y, 5) OVER w) / 2 AS area, count(*) OVER (PARTITION BY plate, well, channel) AS n FROM lg WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan), f AS (PARTITION BY plate, well, channel ORDER BY scan ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"
ED = "ed AS (SELECT DISTINCT plate, well, CASE event_type WHEN 'error' THEN 'delete' ELSE 'add' END AS op, event_id % 500 AS scan FROM events JOIN (SELECT DISTINCT plate, well FROM tr) ON well = user_id WHERE event_type IN ('error', 'purchase'))"
OVERLAY = "SELECT plate, well, channel, scan, false AS manual FROM pk ANTI JOIN (SELECT * FROM ed WHERE op = 'delete') USING (plate, well, scan) UNION ALL SELECT plate, well, 'c1' AS channel, scan, true AS manual FROM (SELECT plate, well, scan FROM ed WHERE op = 'add') ANTI JOIN (SELECT plate, well, scan FROM pk ANTI JOIN (SELECT * FROM ed WHERE op = 'delete') USING (plate, well, scan)) USING (plate, well, scan)"
MFP = "mp AS (SELECT plate, well, scan, height, height AS area FROM (SELECT *, max(height) OVER (PARTITION BY plate, well) AS t FROM pk) WHERE height >= 0.99 * t)"
MF = MFP + """,
ma AS (SELECT plate, well, count(*) AS n_peaks, sum(area) AS total, list(area ORDER BY area DESC) AS a FROM mp GROUP BY ALL),
m4 AS (SELECT plate, well, list(area ORDER BY scan) AS f FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY height DESC, scan) AS k FROM mp) WHERE k <= 4 GROUP BY ALL),
mf AS (SELECT plate, well, n_peaks, CASE WHEN total <= 0 OR n_peaks = 1 THEN 0.0 WHEN n_peaks = 2 THEN CASE WHEN a[2] / total < 0.2 THEN 0.0 ELSE a[2] / total END WHEN n_peaks = 3 THEN (a[2] + a[3]) / total ELSE least(f[1] + f[2], f[3] + f[4]) / (f[1] + f[2] + f[3] + f[4]) END AS mf,
  CASE WHEN total <= 0 THEN 'no signal' WHEN n_peaks = 1 THEN 'homoduplex' WHEN n_peaks < 4 THEN 'partial' ELSE 'heteroduplex' END AS status FROM ma JOIN m4 USING (plate, well))"""
AMP = "am AS (SELECT DISTINCT tp.plate, tp.well FROM tp JOIN rf ON rf.plate = tp.plate AND tp.scan BETWEEN greatest(0, ref_scan - 30) AND greatest(0, ref_scan - 1))"
PR = "pr AS (SELECT source AS plate, CAST(quality AS INTEGER) AS ref, CAST(toxic AS INTEGER) AS pred FROM labels JOIN documents USING (doc_id))"
NR = "SELECT n_name, n_nationkey FROM nation"
RUN = "CAST(CAST(n_nationkey % 4 AS INTEGER) AS VARCHAR)"
FOLDERS = f"fo AS (SELECT CASE n_nationkey % 6 WHEN 0 THEN n_name || '_Run0' || {RUN} WHEN 1 THEN n_name || '_Run' || {RUN} WHEN 2 THEN n_name || '_Run0' || {RUN} || '_b' WHEN 3 THEN 'x' || n_name || '_Run0' || {RUN} WHEN 4 THEN substr(n_name, 1, 5) ELSE n_name || '_160910Run' || {RUN} END AS folder FROM nation), wt AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN substr(n_name, 2, 4) || '_' ELSE n_name || '_Run' || {RUN} END AS wanted FROM nation)"
NORM = lambda c: f"(CASE WHEN regexp_extract({c}, 'Run(\\d+)$', 1) = '' THEN {c} ELSE regexp_replace({c}, 'Run\\d+$', 'Run') || lpad(regexp_extract({c}, 'Run(\\d+)$', 1), 2, '0') END)"
PAIRS = list(combinations(CHANNELS, 2))
FEAT = ["c3 / o AS snr", "c3 / (c2 + 1) AS ratio", "(c3 - min(c3) OVER f) / o AS prominence", "stddev_pop(c3) OVER f / o AS local_std", "c3 / (max(c2) OVER f + 1) AS to_product"]
FEAT += [f"coalesce({'c3' if k == 0 else f'lead(c3, {k}) OVER w' if k > 0 else f'lag(c3, {-k}) OVER w'}, {'first_value(c3) OVER u' if k < 0 else 'last_value(c3) OVER u'}) / o AS at_{k + 4}" for k in range(-4, 5)]

QUERIES: v.Queries = {
    "local_maxima": (local_maxima, sql("SELECT * FROM pk", TR, lg("c1", "c2"), PK)),
    "height_filter_peaks": (height_filter_peaks, sql("SELECT plate, well, channel, scan, height FROM pk JOIN nl USING (plate, well, channel) WHERE height >= greatest(50, 1.2 * noise)", TR, lg("c1"), PK, NL)),
    "scan_range": (scan_range, sql("SELECT * FROM pk WHERE scan BETWEEN 150 AND 300", TR, "lg AS (SELECT plate, well, 'c1' AS channel, scan, c1 AS y FROM tr WHERE scan >= 100 AND scan < 500)", PK)),
    "relative_height": (relative_height, sql("SELECT * EXCLUDE t FROM (SELECT *, max(height) OVER (PARTITION BY plate, well) AS t FROM pk) WHERE height >= 0.8 * t", TR, lg("c1"), PK)),
    "long_wells": (long_wells, sql("SELECT plate, well, count(*) AS n FROM tr GROUP BY ALL HAVING count(*) >= 550", TR)),
    "fwhm_walk": (fwhm_walk, sql('SELECT p.plate, p.well, p.channel, p.scan, p.height, coalesce(max(q.scan) FILTER (WHERE q.y <= p.height / 2 AND q.scan < p.scan), min(q.scan)) AS "left", coalesce(min(q.scan) FILTER (WHERE q.y <= p.height / 2 AND q.scan > p.scan), max(q.scan)) AS "right", coalesce(min(q.scan) FILTER (WHERE q.y <= p.height / 2 AND q.scan > p.scan), max(q.scan)) - coalesce(max(q.scan) FILTER (WHERE q.y <= p.height / 2 AND q.scan < p.scan), min(q.scan)) AS fwhm FROM tp p JOIN lg q ON p.plate = q.plate AND p.well = q.well GROUP BY p.plate, p.well, p.channel, p.scan, p.height', TR, lg("c1"), PK, ALL)),
    "stutter_group": (stutter_group, sql("SELECT plate, well, channel, arg_min(scan, (-height, scan)) AS scan, max(height) AS height, min(scan) AS first_scan, max(scan) AS last_scan, count(*) AS n_merged FROM (SELECT *, sum(cut) OVER (PARTITION BY plate, well, channel ORDER BY scan) AS g FROM (SELECT *, CASE WHEN scan - lag(scan) OVER (PARTITION BY plate, well, channel ORDER BY scan) > 5 THEN 1 ELSE 0 END AS cut FROM pk)) GROUP BY plate, well, channel, g", TR, lg("c1"), PK)),
    "threshold_groups": (threshold_groups, sql("SELECT * REPLACE (round(area, 2) AS area) FROM tg", TR, lg("c1", "c2"), TG)),
    "refine_noise_filter": (refine_noise_filter, sql('SELECT * EXCLUDE t REPLACE (round(area, 2) AS area) FROM (SELECT *, max(height) OVER (PARTITION BY plate, well, channel) AS t FROM (SELECT plate, well, channel, arg_max(scan, rn) AS scan, arg_max(height, rn) AS height, arg_max(area, rn) AS area, arg_max("left", rn) AS "left", arg_max("right", rn) AS "right", arg_max(n_points, rn) AS n_points FROM r GROUP BY plate, well, channel, grp)) WHERE height >= 0.9 * t', TR, lg("c1"), TG, "o AS (SELECT *, row_number() OVER (PARTITION BY plate, well, channel ORDER BY scan) AS rn FROM tg)", 'r AS (SELECT plate, well, channel, rn, scan, height, area, "left", "right", n_points, 1 AS grp FROM o WHERE rn = 1 UNION ALL SELECT o.plate, o.well, o.channel, o.rn, CASE WHEN o.scan - r.scan <= 12 AND o.height <= r.height THEN r.scan ELSE o.scan END, CASE WHEN o.scan - r.scan <= 12 THEN greatest(o.height, r.height) ELSE o.height END, CASE WHEN o.scan - r.scan <= 12 THEN r.area + o.area ELSE o.area END, CASE WHEN o.scan - r.scan <= 12 THEN r."left" ELSE o."left" END, o."right", CASE WHEN o.scan - r.scan <= 12 THEN r.n_points + o.n_points ELSE o.n_points END, CASE WHEN o.scan - r.scan <= 12 THEN r.grp ELSE r.grp + 1 END FROM r JOIN o ON o.plate = r.plate AND o.well = r.well AND o.channel = r.channel AND o.rn = r.rn + 1)', recursive=True)),
    "top_n_peaks": (top_n_peaks, sql("SELECT * FROM tp", TR, lg("c1"), PK, TOP(4))),
    "primer_removal": (primer_removal, sql("SELECT plate, well, channel, scan, height FROM (SELECT *, row_number() OVER w AS k, lead(scan) OVER w - scan AS gap FROM tp WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan)) WHERE NOT (k = 1 AND coalesce(gap > 30, false))", TR, lg("c1"), PK, TOP(4))),
    "peak_area_window": (peak_area_window, sql("SELECT pk.*, round(area, 3) AS area FROM pk JOIN wa USING (plate, well, channel, scan) WHERE scan >= 5 AND scan < n - 5", TR, lg("c1"), PK, AREA5)),
    "is_filter_topn": (is_filter_topn, sql("SELECT plate, well, channel, scan, height FROM (SELECT *, row_number() OVER (PARTITION BY plate, well, channel ORDER BY height DESC, scan) AS k FROM pk) WHERE channel <> 'c1' OR k <= 4", TR, lg("c1", "c2"), PK)),
    "is_area_ratio": (is_area_ratio, sql("SELECT plate, max(a) FILTER (WHERE channel = 'c1' AND k = 3) AS standard_area, sum(a) AS total_area, round(coalesce(sum(a) / nullif(max(a) FILTER (WHERE channel = 'c1' AND k = 3), 0), 0), 4) AS ratio FROM (SELECT pk.plate, pk.channel, round_even(area, 0) AS a, row_number() OVER (PARTITION BY pk.plate ORDER BY CASE WHEN pk.channel = 'c1' THEN 0 ELSE 1 END, pk.well, pk.scan) AS k FROM pk JOIN wa USING (plate, well, channel, scan) WHERE scan >= 5 AND scan < n - 5) GROUP BY plate", TR, lg("c1", "c2"), PK, AREA5)),
    "peak_edits_overlay": (peak_edits_overlay, sql(OVERLAY, TR, lg("c1"), PK, ED)),
    "clear_all": (clear_all, sql("SELECT plate, well, count(*) AS n_left FROM pk WHERE well <> (SELECT min(q.well) FROM pk q WHERE q.plate = pk.plate) GROUP BY ALL", TR, lg("c1"), PK)),
    "nearest_is_match": (nearest_is_match, sql("SELECT plate, ref_idx, ref_scan, well, scan, height FROM (SELECT *, count(*) OVER (PARTITION BY plate, well) AS m FROM (SELECT rf.plate, ref_idx, ref_scan, well, scan, round(height, 4) AS height, row_number() OVER (PARTITION BY rf.plate, well, ref_idx ORDER BY abs(scan - ref_scan), scan) AS k FROM rf JOIN tp ON rf.plate = tp.plate AND abs(scan - ref_scan) <= 50) WHERE k = 1) WHERE m >= 3", TR, lg("c3"), PK, ALL, RF)),
    "is_raw_argmax": (is_raw_argmax, sql("SELECT plate, well, ref_idx, ref_scan, scan, round(height, 4) AS height FROM (SELECT *, row_number() OVER (PARTITION BY plate, well, scan ORDER BY abs(scan - ref_scan), ref_idx) AS k FROM (SELECT tr.plate, tr.well, ref_idx, ref_scan, arg_min(scan, (-c3, scan)) AS scan, max(c3) AS height, max(sd) AS sd FROM (SELECT *, stddev_pop(CASE WHEN scan < 200 THEN c3 END) OVER (PARTITION BY plate, well) AS sd FROM tr) tr JOIN rf ON rf.plate = tr.plate AND scan >= ref_scan - 80 AND scan < ref_scan + 80 GROUP BY ALL) WHERE height >= greatest(100, 2 * sd)) WHERE k = 1", TR, RF)),
    "is_quality": (is_quality, sql("SELECT plate, well, scan, round(avg(c3) OVER (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS quality FROM tr", TR)),
    "is_consistent": (is_consistent, sql("SELECT plate, ref AS scan, count(*) AS n_wells, round(stddev_pop(scan), 3) AS std_scan, round(max(rq) / greatest(stddev_pop(scan), 0.1), 3) AS score FROM nn GROUP BY plate, ref, nw HAVING count(*) >= greatest(4, floor(nw * 0.3)) AND stddev_pop(scan) <= 15 AND max(rq) > 0", TR, lg("c3"), PK, ALL, "qq AS (SELECT plate, well, scan, avg(c3) OVER (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS quality FROM tr)", "tq AS (SELECT tp.*, quality FROM tp JOIN qq USING (plate, well, scan))", "fw AS (SELECT plate, min(well) AS well, count(DISTINCT well) AS nw FROM tq GROUP BY plate)", "cd AS (SELECT plate, scan AS ref, quality AS rq, nw FROM (SELECT tq.*, nw, row_number() OVER (PARTITION BY plate ORDER BY height DESC, scan) AS k FROM tq JOIN fw USING (plate, well) WHERE scan >= 20) WHERE k <= 40)", "nn AS (SELECT * FROM (SELECT cd.*, tq.well, tq.scan, row_number() OVER (PARTITION BY cd.plate, ref, tq.well ORDER BY abs(tq.scan - ref), tq.scan) AS k FROM cd JOIN tq ON tq.plate = cd.plate AND abs(tq.scan - ref) <= 25) WHERE k = 1)")),
    "is_combo_search": (is_combo_search, sql("SELECT plate, p1, p2, p3, p4, total FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY total DESC, p1, p2, p3, p4) AS k FROM (SELECT plate, p1, p2, p3, p4, round((s1 + s2 + s3 + s4) * ((p4 - p1) / 3000.0) / (1 + sqrt(((p2 - p1 - m) ** 2 + (p3 - p2 - m) ** 2 + (p4 - p3 - m) ** 2) / 3) / greatest(m, 1.0)), 6) AS total FROM cs)) WHERE k = 1", TR, lg("c1"), PK, "bp AS (SELECT plate, scan, round(height / 1000, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY height DESC, scan, well) AS k FROM (SELECT plate, scan, max(height) AS height, min(well) AS well FROM pk GROUP BY ALL)) WHERE k <= 40)", "cs AS (SELECT a.plate, a.scan AS p1, b.scan AS p2, c.scan AS p3, d.scan AS p4, a.score AS s1, b.score AS s2, c.score AS s3, d.score AS s4, (d.scan - a.scan) / 3.0 AS m FROM bp a JOIN bp b ON a.plate = b.plate AND b.scan - a.scan >= 10 JOIN bp c ON a.plate = c.plate AND c.scan - b.scan >= 10 JOIN bp d ON a.plate = d.plate AND d.scan - c.scan >= 10 WHERE d.scan - a.scan >= 150)")),
    "is_features": (is_features, sql("SELECT plate, well, scan, " + ", ".join(f"round({e.split(' AS ')[0]}, 4) AS {e.split(' AS ')[1]}" for e in FEAT) + " FROM (SELECT tr.*, noise + 1 AS o FROM tr JOIN nl USING (plate, well)) WINDOW w AS (PARTITION BY plate, well ORDER BY scan), u AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), f AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)", TR, lg("c3"), NL)),
    "is_spacing": (is_spacing, sql("SELECT plate, quantile_cont(gap, 0.5) AS spacing, count(*) AS n_gaps FROM (SELECT plate, scan - lag(scan) OVER (PARTITION BY plate, well ORDER BY scan) AS gap FROM tp) WHERE gap IS NOT NULL GROUP BY plate", TR, lg("c3"), PK, TOP(6))),
    "amplification_semi": (amplification_semi, sql("SELECT plate, well FROM am", TR, lg("c1", "c2"), PK, HIGH("0.98"), RF, AMP)),
    "background_anti": (background_anti, sql('SELECT plate, well, count(*) AS n, min(scan) AS "first", CAST(sum(scan) AS BIGINT) AS sum_position FROM (SELECT tr.plate, tr.well, scan, count(*) OVER (PARTITION BY plate, well) AS n FROM tr) t WHERE scan >= 15 AND scan < n - 15 AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.plate = t.plate AND tp.well = t.well AND abs(tp.scan - t.scan) <= 20) GROUP BY ALL', TR, lg("c1"), PK, HIGH("0.98"))),
    "sample_is_interval_join": (sample_is_interval_join, sql("SELECT a.plate, a.well, a.scan AS standard_scan, max(b.scan) AS scan, count(*) AS n_inside FROM s4 a JOIN s20 b ON a.plate = b.plate AND a.well = b.well AND b.scan BETWEEN a.scan - 25 AND a.scan - 5 GROUP BY ALL", TR, lg("c2", "c3"), PK, ALL, "s20 AS (SELECT * FROM tp WHERE channel = 'c2')", "s4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY height DESC, scan) AS k FROM tp WHERE channel = 'c3') WHERE k <= 4)")),
    "match_samples": (match_samples, None),
    "background_range_anti": (background_range_anti, sql("SELECT plate, well, scan, height FROM pk a WHERE channel = 'c1' AND NOT EXISTS (SELECT 1 FROM tp b WHERE a.plate = b.plate AND a.well = b.well AND abs(a.scan - b.scan) <= 10)", TR, lg("c1", "c3"), PK, "tp AS (SELECT plate, well, scan FROM (SELECT *, max(height) OVER (PARTITION BY plate, well) AS t FROM pk WHERE channel = 'c3') WHERE height >= 0.9 * t)")),
    "gene_ref_containment": (gene_ref_containment, sql("SELECT plate, gene, ref_scan FROM (SELECT *, dense_rank() OVER (PARTITION BY plate ORDER BY length(gene) DESC, gene) AS k FROM pl JOIN ge ON contains(plate, gene) OR contains(gene, plate)) WHERE k = 1", "pl AS (SELECT n_name || '_' || r_name || '_Run1' AS plate FROM nation JOIN region ON n_regionkey = r_regionkey)", "ge AS (SELECT r_name AS gene, CAST(r_regionkey * 100 AS BIGINT) AS ref_scan FROM region UNION ALL SELECT substr(r_name, 1, 2), CAST(r_regionkey * 7 AS BIGINT) FROM region)")),
    "fuzzy_plate_match": (fuzzy_plate_match, sql(f"SELECT wanted, folder, how FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY how, folder) AS k FROM (SELECT wanted, folder, CASE WHEN wanted = folder THEN 0 WHEN wn = fn THEN 1 WHEN starts_with(folder, wn) THEN 2 WHEN contains(fn, wn) OR contains(wn, fn) THEN 3 END AS how FROM (SELECT wanted, folder, {NORM('wanted')} AS wn, {NORM('folder')} AS fn FROM wt, fo)) WHERE how IS NOT NULL) WHERE k = 1", FOLDERS)),
    "trace_stats": (trace_stats, sql("SELECT plate, well, count(*) AS n_scans, " + ", ".join(f"round(avg({c}), 2) AS {c}_mean, round(stddev_pop({c}), 2) AS {c}_std, round(max({c}), 3) AS {c}_max, round(min({c}), 3) AS {c}_min, round((avg({c} ** 3) - 3 * avg({c}) * avg({c} ** 2) + 2 * avg({c}) ** 3) / stddev_pop({c}) ** 3, 3) AS {c}_skew, round(kurtosis_pop({c}), 3) AS {c}_kurt, round(sum({c} * {c}), 0) AS {c}_energy, round(quantile_cont({c}, 0.25), 4) AS {c}_p25, round(quantile_cont({c}, 0.5), 4) AS {c}_median, round(quantile_cont({c}, 0.75), 4) AS {c}_p75" for c in ("c1", "c2")) + " FROM tr GROUP BY ALL", TR)),
    "region_stats": (region_stats, sql("SELECT plate, well, channel, count(*) AS n_peaks, round(avg(height), 3) AS mean_height, max(height) AS max_height, round(sum(height), 2) AS sum_height, min(scan) AS first_scan, max(scan) AS last_scan, max(scan) - min(scan) AS spread FROM pk GROUP BY ALL", TR, "lg AS (SELECT plate, well, 'c1' AS channel, scan, c1 AS y FROM tr WHERE scan >= 150 AND scan < 400 UNION ALL SELECT plate, well, 'c2', scan, c2 FROM tr WHERE scan >= 150 AND scan < 400)", PK)),
    "channel_corr": (channel_corr, sql("SELECT plate, well, " + ", ".join(f"round(CASE WHEN count(*) > 50 THEN coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0) ELSE 0 END, 6) AS corr_{a}_{b}" for a, b in PAIRS) + " FROM tr GROUP BY ALL", TR)),
    "standard_features": (standard_features, sql("SELECT plate, well, CAST(len(s) AS DOUBLE) AS is_count, CAST(s[-1] - s[1] AS DOUBLE) AS is_span, " + ", ".join(f"CAST(coalesce(s[{i}], 0) AS DOUBLE) AS is_scan_{i}, CAST(coalesce(h[{i}], 0) AS DOUBLE) AS is_height_{i}" for i in range(1, 5)) + ", " + ", ".join(f"CAST(CASE WHEN len(s) > {i} THEN s[{i + 1}] - s[{i}] ELSE 0 END AS DOUBLE) AS is_gap_{i}" for i in range(1, 4)) + " FROM (SELECT plate, well, list(scan ORDER BY scan) AS s, list(height ORDER BY scan) AS h FROM tp GROUP BY ALL) WHERE len(s) >= 2", TR, lg("c1"), PK, TOP(4))),
    "robust_scale": (robust_scale, sql("SELECT plate, well, round((m - quantile_cont(m, 0.5) OVER p) / greatest(quantile_cont(m, 0.75) OVER p - quantile_cont(m, 0.25) OVER p, 1e-8), 4) AS m, round((x - quantile_cont(x, 0.5) OVER p) / greatest(quantile_cont(x, 0.75) OVER p - quantile_cont(x, 0.25) OVER p, 1e-8), 4) AS x FROM (SELECT plate, well, round(avg(c1), 6) AS m, max(c2) AS x FROM tr GROUP BY ALL) WINDOW p AS (PARTITION BY plate)", TR)),
    "mutant_fraction": (mutant_fraction, sql("SELECT plate, well, n_peaks, round(mf, 6) AS mf, status FROM mf", TR, lg("c1"), PK, MF)),
    "plate_summary_rollup": (plate_summary_rollup, sql("SELECT plate, count(*) AS n_wells, count(*) FILTER (WHERE n_peaks = 1) AS n_one, count(*) FILTER (WHERE n_peaks = 4) AS n_four, count(*) FILTER (WHERE n_peaks NOT IN (1, 4)) AS n_other FROM mf GROUP BY ROLLUP (plate)", TR, lg("c1"), PK, MF)),
    "plate_grade": (plate_grade, sql("SELECT plate, round(pw, 3) AS per_well, fwhm, CASE WHEN pw < 2.5 THEN 'FAILED' WHEN fwhm < 10 THEN 'GOOD' WHEN fwhm < 15 THEN 'FAIR' ELSE 'POOR' END AS grade FROM (SELECT plate, count(*) / count(DISTINCT well) AS pw, quantile_cont(fwhm, 0.5) AS fwhm FROM hw GROUP BY plate)", TR, lg("c1"), PK, TOP(4), "hw AS (SELECT p.plate, p.well, p.scan, coalesce(min(q.scan) FILTER (WHERE q.y <= p.height / 2 AND q.scan > p.scan), max(q.scan)) - coalesce(max(q.scan) FILTER (WHERE q.y <= p.height / 2 AND q.scan < p.scan), min(q.scan)) AS fwhm FROM tp p JOIN lg q ON p.plate = q.plate AND p.well = q.well GROUP BY p.plate, p.well, p.scan, p.height)")),
    "prediction_counts": (prediction_counts, sql("SELECT CASE pred WHEN 0 THEN 'fail' WHEN 1 THEN 'hom1' END AS prediction, count(*) AS n FROM pr GROUP BY ALL", PR)),
    "validation_confusion": (validation_confusion, sql("SELECT plate, ref, pred, count(*) AS n FROM pr GROUP BY ALL UNION ALL SELECT NULL, ref, pred, count(*) FROM pr GROUP BY ref, pred", PR)),
    "validation_accuracy": (validation_accuracy, sql("SELECT plate, count(*) AS n, count(*) FILTER (WHERE ref = pred) AS n_ok, round(100.0 * count(*) FILTER (WHERE ref = pred) / count(*), 2)::DOUBLE AS accuracy FROM pr GROUP BY ROLLUP (plate)", PR)),
    "gated_calls": (gated_calls, sql("SELECT plate, well, CASE WHEN am.well IS NULL THEN 'FAIL' ELSE status END AS prediction, CASE WHEN am.well IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM sw LEFT JOIN am USING (plate, well) LEFT JOIN mf USING (plate, well)", TR, lg("c1", "c2", "c3"), PK.replace("pk AS", "pa AS"), "pk AS (SELECT * FROM pa WHERE channel = 'c1')", MF, "tp AS (SELECT * FROM (SELECT *, max(height) OVER (PARTITION BY plate, well) AS t FROM pa WHERE channel IN ('c1', 'c2')) WHERE height >= 0.98 * t)", RF, AMP, "sw AS (SELECT DISTINCT plate, well FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY height DESC, scan) AS k FROM pa WHERE channel = 'c3') WHERE k <= 3 AND height >= 6000)")),
    "well_set_ops": (well_set_ops, sql("SELECT well, 'union' AS op FROM (SELECT well FROM a UNION SELECT well FROM b) UNION ALL SELECT well, 'intersect' FROM (SELECT well FROM a INTERSECT SELECT well FROM b) UNION ALL SELECT well, 'except' FROM (SELECT well FROM a EXCEPT SELECT well FROM b)", TR, "a AS (SELECT well FROM tr WHERE c1 > 80000)", "b AS (SELECT well FROM tr WHERE c2 > 49000 AND scan < 60)")),
    "find_peaks_full": (find_peaks_full, None),
    "nms_peaks": (nms_peaks, None),
    "broad_split": (broad_split, None),
    "gauss_fit": (gauss_fit, None),
    "spike_filter": (spike_filter, None),
    "spacing_walk": (spacing_walk, None),
    "forest_calls": (forest_calls, None),
}
