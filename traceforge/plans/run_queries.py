"""Queries of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotype as gt
from ..operators import peaks as pk
from ..operators import runs
from ..schema import WELL, WIDTH_HEIGHT
from . import views as v
from .peak_sql import edges, finder
from .signal_queries import EDGE
from .views import TR, lg, sql


def duplex_wells(spark: SparkSession, sf: str) -> DataFrame:
    """GT-15: mutant fractions of wells from fitted peaks; sequential, tested on hand vectors."""
    return runs.duplex_wells(v.trace(spark, sf), 100, 500)


def compact_features(spark: SparkSession, sf: str) -> DataFrame:
    """GT-6, all 32 features; sequential in its peaks, tested on hand vectors."""
    d = runs.compact_features(v.trace(spark, sf), pk.top_peaks(v.peaks(spark, sf, ("c3",)), 4))
    return d.select(*WELL, *[F.round(c, 4).alias(c) for c in d.columns if c not in WELL])


def _figures(d: DataFrame) -> DataFrame:
    """Rounded past exact halves, on which sums in another order would part; energies in millions."""
    scale = lambda c: F.col(c) / 1e6 if c == "energy" else F.col(c)
    return d.select(*[F.round(scale(c) + 1e-7, 4).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def trace_peak_figures(spark: SparkSession, sf: str) -> DataFrame:
    """GT-2: nine figures of each channel's peaks, prominence and width among them."""
    return _figures(gt.trace_peak_stats(v.long(spark, sf)))


def region_figures(spark: SparkSession, sf: str) -> DataFrame:
    """GT-3: level and peaks of a scan region."""
    return _figures(gt.region_features(v.long(spark, sf), 150, 400))


def automatic_standards(spark: SparkSession, sf: str) -> DataFrame:
    """GT-5: fifteen figures of standard peaks found without help, in a trace whose noise is a tenth before scan 200."""
    return _figures(gt.standard_figures(v.trace(spark, sf), gt.automatic_standards(_quiet(spark, sf))))


def _quiet(spark: SparkSession, sf: str) -> DataFrame:
    return v.trace(spark, sf).withColumn("c3", F.when(F.col("scan") < 200, F.col("c3") / 20).otherwise(F.col("c3") * (1 + F.col("current") % 3)))


def detected_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """PK-2 and PK-3: the default detector on all channels: smoothing, height, distance, prominence and width."""
    d = pk.detect_default(v.long(spark, sf))
    return d.select(*pk.BY_CHANNEL, "scan", F.round("height", 4).alias("height"), F.round("prominence", 3).alias("prominence"), F.round("left_at", 3).alias("left_at"))


def plate_run(spark: SparkSession, sf: str) -> DataFrame:
    """GT-17: whole plates; fits have no SQL, each filter is tested on hand vectors."""
    d = runs.plate_run(v.trace(spark, sf), 100, 500)
    return d.select(*WELL, "grade", "n_peaks", F.round("mf", 6).alias("mf"), "status", F.size("scans").alias("n_scans"))


KEYS = "plate, well, channel"
FIGURES = "count(*) AS n_peaks, avg(s) AS mean_height, max(s) AS max_height, sum(s) AS sum_height, avg(prom) AS mean_prominence, avg(width) AS mean_width, min(pos) AS first_scan, max(pos) AS last_scan, max(pos) - min(pos) AS spread"
INT, DEC = ("n_peaks", "first_scan", "last_scan", "spread"), ("mean_height", "max_height", "sum_height", "mean_prominence", "mean_width")


def _zeros(*names: str) -> str:
    return ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" if c in INT else f"round(coalesce({c}, 0) + 1e-7, 4) AS {c}" for c in names)


def _source(name: str, rows: str, least: int, head: int) -> str:
    """Samples with their place, and the least height: a fixed one, or three deviations of the head."""
    noise = f"CASE WHEN count(*) OVER k > {head} THEN stddev_pop(y) FILTER (WHERE pos < {head}) OVER k ELSE stddev_pop(y) OVER k END"
    return f"{name} AS MATERIALIZED (SELECT {KEYS}, pos, y AS s, greatest({least}, 3 * ({noise})) AS thr FROM ({rows}) WINDOW k AS (PARTITION BY {KEYS}))"


WHOLE = [TR, lg(), _source("wh", f"SELECT {KEYS}, scan AS pos, y FROM lg", 50, 200), *finder("wh", "fp", "thr", 5, "thr / 2", 1)]
REGION = [TR, lg(), "rg AS (SELECT *, count(*) OVER (PARTITION BY plate, well, channel) AS n FROM lg WHERE scan >= 150 AND scan < 400)", _source("wh", f"SELECT {KEYS}, scan - 150 AS pos, y FROM rg WHERE n > 50", 20, 100), *finder("wh", "fp", "thr", 5, "thr / 2", 1)]
QUIET = "qt AS MATERIALIZED (SELECT plate, well, 'c3' AS channel, scan AS pos, CASE WHEN scan < 200 THEN c3 / 20 ELSE c3 * (1 + current % 3) END AS s, c2 FROM tr)"
NOISY = "ns AS MATERIALIZED (SELECT plate, well, channel, pos, s, CASE WHEN count(*) OVER k > 200 THEN stddev_pop(s) FILTER (WHERE pos < 200) OVER k ELSE stddev_pop(s) OVER k END AS nz FROM qt WINDOW k AS (PARTITION BY plate, well))"
SLOTS = ", ".join(f"CAST(coalesce(ps[{i}].pos, 0) AS BIGINT) AS is_peak_{i}_scan, round(coalesce(ps[{i}].s, 0) + 1e-7, 4) AS is_peak_{i}_height" for i in range(1, 5))

QUERIES: v.Queries = {
    "duplex_wells": (duplex_wells, None),
    "compact_features": (compact_features, None),
    "plate_run": (plate_run, None),
    "detected_peaks": (detected_peaks, sql(f"SELECT fp.plate, fp.well, fp.channel, fp.pos AS scan, round(y, 4) AS height, round(prom, 3) AS prominence, round({edges(WIDTH_HEIGHT)[0]}, 3) AS left_at FROM (SELECT fp.*, ss.y FROM fp JOIN ss USING (plate, well, channel, pos)) fp", TR, *EDGE[:-1])),
    "trace_peak_figures": (trace_peak_figures, sql(f"SELECT {KEYS}, {_zeros(*INT, *DEC)} FROM (SELECT DISTINCT {KEYS} FROM lg) LEFT JOIN (SELECT {KEYS}, {FIGURES} FROM fp GROUP BY ALL) USING ({KEYS})", *WHOLE)),
    "region_figures": (region_figures, sql(f"SELECT {KEYS}, round(coalesce(mean, 0) + 1e-7, 4) AS mean, round(coalesce(std, 0) + 1e-7, 4) AS std, round(coalesce(top, 0) + 1e-7, 4) AS max, round(coalesce(energy, 0) / 1e6 + 1e-7, 4) AS energy, {_zeros('n_peaks', 'mean_height', 'max_height', 'mean_prominence', 'mean_width')} FROM (SELECT DISTINCT {KEYS} FROM lg) LEFT JOIN (SELECT {KEYS}, avg(s) AS mean, stddev_pop(s) AS std, max(s) AS top, sum(s * s) AS energy FROM wh GROUP BY ALL) USING ({KEYS}) LEFT JOIN (SELECT {KEYS}, {FIGURES} FROM fp GROUP BY ALL) USING ({KEYS})", *REGION)),
    "automatic_standards": (automatic_standards, sql(f"SELECT plate, well, CAST(coalesce(n, 0) AS BIGINT) AS is_n_peaks, round(coalesce(mx, 0) + 1e-7, 4) AS is_max_height, round(coalesce(sm, 0) + 1e-7, 4) AS is_total_height, round(coalesce(av, 0) + 1e-7, 4) AS is_mean_height, CAST(coalesce(fs, 0) AS BIGINT) AS is_first_scan, CAST(coalesce(ls, 0) AS BIGINT) AS is_last_scan, CAST(coalesce(ls - fs, 0) AS BIGINT) AS is_spread, {SLOTS} FROM (SELECT DISTINCT plate, well FROM tr) LEFT JOIN (SELECT plate, well, count(*) AS n, max(s) AS mx, sum(s) AS sm, avg(s) AS av, min(pos) AS fs, max(pos) AS ls, list({{pos: pos, s: s}} ORDER BY pos) AS ps FROM (SELECT fp.* FROM fp JOIN qt USING (plate, well, pos) JOIN (SELECT plate, well, any_value(nz) AS nz FROM ns GROUP BY ALL) USING (plate, well) WHERE CASE WHEN c2 > 10 THEN fp.s / c2 ELSE 999 END > 2 AND fp.s > 10 * nz) GROUP BY ALL) USING (plate, well)", TR, QUIET, NOISY, *finder("ns", "fp", "10 * nz", 15, "5 * nz", 3))),
}
