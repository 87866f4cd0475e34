"""Whole runs composed of the operators: duplex wells with their mutant fraction, and the compact features of a well.

Wells without peaks keep their row, with zeros; a well is one group of the sequential steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as k
from ..schema import DUPLEX_REGION, NOISE_SCANS, PLATE_RUN, WELL
from . import genotype as gt
from . import peaks as pk
from . import signal as sg
from .joins import by_group


def duplex_wells(trace: DataFrame, low: int = DUPLEX_REGION[0], high: int = DUPLEX_REGION[1], standard: str = "c3", sample: str = "c2") -> DataFrame:
    """Mutant fraction of each well from the sample channel in [low, high), its peaks' areas over the standard's first.

    Standard: groups over 8 % of the range, not split, doublets merged, from 10 % of the tallest. Sample: groups over 15 %, broad
    ones split, merged, from 15 %; then a Gaussian each, fitted to the smoothed region. Rows: n_peaks, mf, status, standard_area (0 if none), scans, norm_areas.
    """
    inside = trace.where((F.col("scan") >= low) & (F.col("scan") < high)).withColumn("scan", F.col("scan") - low)
    std, smp = sg.to_long(inside, [standard]), sg.to_long(inside, [sample])
    first = pk.refine(pk.found_groups(std, 0.08, 6), 3, 0.1).groupBy(*WELL).agg(F.min_by("area", "scan").alias("standard_area"))
    parts = pk.found_groups(smp, 0.15, 6, split=(50, 6)).withColumns({"left": F.col("scan"), "right": F.col("scan"), "n_points": F.lit(1)})
    found = pk.refine(parts, 3, 0.15)
    # Read by two aggregates below: the fit is the dear step, and its rows are few.
    item = F.struct((F.col("scan") + low).alias("scan"), "height", "area")
    fitted = pk.deconvolve(smp, found, smooth=7).repartition(*WELL).groupBy(*WELL).agg(F.array_sort(F.collect_list(item)).alias("p"))
    calls = gt.mutant_fraction(fitted.select(*WELL, F.inline("p")))
    area = F.coalesce("standard_area", F.lit(0.0))
    norm = F.transform("p", lambda x: F.when(F.col("standard_area") > 0, x["area"] / F.col("standard_area")).otherwise(0.0))
    d = trace.select(*WELL).distinct().join(calls, WELL, "left").join(fitted, WELL, "left").join(first, WELL, "left")
    none = F.expr("cast(array() as array<double>)")
    return d.select(
        *WELL, F.coalesce("n_peaks", F.lit(0)).cast("long").alias("n_peaks"), F.coalesce("mf", F.lit(0.0)).alias("mf"), F.coalesce("status", F.lit("no peaks")).alias("status"),
        area.alias("standard_area"), F.coalesce(F.col("p.scan"), none).alias("scans"), F.coalesce(norm, none).alias("norm_areas"),
    )


def transformed(trace: DataFrame, norm: bool = True, align: bool = True, matrix=None) -> DataFrame:
    """The transforms of a viewer, always from the pristine trace and in this order: the scan axis by the current, then by the left edge of each well's tallest peak as it lies on that axis, then dyes from channels (``matrix`` unless null).

    ``scan_pos`` is the axis; peaks are detected on the channels as they came.
    """
    d = sg.normalise_current(trace) if norm else trace.withColumn("scan_pos", F.col("scan").cast("double"))
    if align:
        d = sg.align_to_left_edge(d.withColumnRenamed("scan_pos", "_axis"), pk.detect_default(sg.to_long(trace)), "_axis").drop("_axis", "shift")
    return d if matrix is None else sg.unmix(d, matrix)


def plate_quality(standards: DataFrame, samples: DataFrame, wells: DataFrame) -> DataFrame:
    """Each plate's grade from all its wells: standard peaks a well, and the median half widths of standard and (narrow) sample peaks (column fwhm).

    A plate without standard peaks is FAILED; one without narrow sample peaks has 99 for their width.
    """
    half = lambda d, name: d.groupBy("plate").agg(F.percentile("fwhm", F.lit(0.5)).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))
    d = wells.groupBy("plate").agg(F.countDistinct("well").alias("_wells")).join(half(standards, "standard_fwhm"), "plate", "left").join(half(samples, "sample_fwhm"), "plate", "left")
    d = d.select("plate", (F.coalesce("standard_fwhm_n", F.lit(0)) / F.col("_wells")).alias("per_well"), "standard_fwhm", F.coalesce("sample_fwhm", F.lit(99.0)).alias("sample_fwhm"))
    return d.withColumn("grade", F.when(F.col("standard_fwhm").isNull(), "FAILED").otherwise(gt.quality_grade(F.col("per_well"), F.col("standard_fwhm"), F.col("sample_fwhm"))))


def _well_peaks(trace: DataFrame, low: int, high: int, standard: str, sample: str) -> DataFrame:
    """What a plate run needs of each well's traces, in one pass: rows of (kind, scan, height, area, fwhm, top_width).

    ``standard``: peaks over 500 in [low, high), 25 scans apart, 300 prominent, with the trapezoid area of the 5 scans on both sides there. ``narrow``: sample peaks over 2000, 10 apart,
    less than 30 wide. ``sample``: tops of groups over 15 % of the range, parted at gaps over 15 scans and, where wider than 20, at their inner peaks; areas are
    sums of 17 samples. ``fwhm`` is seen in [low, high), ``top_width`` is that of the greatest sample near the peak (20 scans before to 19 after; samples 30 and 29) in the whole trace.
    ``well``: a row for each well with scans in [low, high).
    """

    def around(scan: np.ndarray, begin: np.ndarray, trace: np.ndarray, row: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the same trace from ``before`` scans before to ``after`` scans after."""
        span = int(scan.max(initial=0) - scan.min(initial=0)) + before + after + 2
        place = scan + np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * span
        return np.searchsorted(place, place[row] - before), np.searchsorted(place, place[row] + after, "right")

    def sums(y: np.ndarray, row: np.ndarray, reach: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row))
        for i in range(-reach, reach + 1):
            at = row + i
            out += np.where((at >= begin) & (at < end), y[np.clip(at, 0, max(len(y) - 1, 0))], 0.0)
        return out

    def run(t: pa.Table, begin: np.ndarray) -> dict[str, np.ndarray]:
        scan = t.column("scan").to_numpy()
        std, smp = (t.column(c).to_numpy().astype(float) for c in (standard, sample))
        pairs = list(zip(begin[:-1].tolist(), begin[1:].tolist()))
        lo, hi = (np.array([i + np.searchsorted(scan[i:j], at) for i, j in pairs], int) for at in (low, high))
        parts = lambda y: [y[i:j] for i, j in zip(lo.tolist(), hi.tolist())]
        rows: list[tuple] = []

        def put(kind: str, y: np.ndarray, trace: np.ndarray, row: np.ndarray, area: np.ndarray | None, before: int, after: int, keep: Callable | None = None) -> None:
            left, right = k.half_widths(y, row, y[row], lo[trace], hi[trace])
            fwhm = (scan[right] - scan[left]).astype(float)
            if keep is not None:
                trace, row, fwhm = (v[keep(fwhm)] for v in (trace, row, fwhm))
            none = np.full(len(row), np.nan)
            top = k.top_widths(y, *around(scan, begin, trace, row, before, after)) if before else none
            rows.append((trace, np.full(len(row), kind, object), scan[row], y[row], none if area is None else area, fwhm, top))

        p = k.find_many(parts(std), 500, 25, 300)
        row = lo[p.trace] + p.place
        b, e = np.maximum(row - 5, lo[p.trace]), np.minimum(row + 6, hi[p.trace])
        put("standard", std, p.trace, row, sums(std, row, 5, lo[p.trace], hi[p.trace]) - (std[b] + std[e - 1]) / 2, 20, 19)
        p = k.find_many(parts(smp), 2000, 10)
        put("narrow", smp, p.trace, lo[p.trace] + p.place, None, 0, 0, lambda fwhm: fwhm < 30)
        trace, row = _parted_tops(scan, smp, lo, hi, low)
        put("sample", smp, trace, row, sums(smp, row, 8, begin[trace], begin[trace + 1]), 30, 29)
        some = np.flatnonzero(hi > lo)
        none = np.full(len(some), np.nan)
        rows.append((some, np.full(len(some), "well", object), np.zeros(len(some), int), none, none, none, none))
        names = ("trace", "kind", "scan", "height", "area", "fwhm", "top_width")
        return {c: np.concatenate(v) for c, v in zip(names, zip(*rows))}

    schema = "kind string, scan long, height double, area double, fwhm double, top_width double"
    return pk.by_trace(trace.select(*WELL, F.col("scan").cast("long").alias("scan"), standard, sample), WELL, run, schema)


def _parted_tops(scan: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Traces and rows of the sample peaks: tops of the groups in each trace's rows [lo, hi), or where a group is wider than 20 its peaks that are 10 apart and stand out by 3 % of the range over the median of the first 100."""
    rows = np.concatenate([np.arange(i, j) for i, j in zip(lo.tolist(), hi.tolist())] or [np.zeros(0, int)])
    begin = np.append(0, np.cumsum(hi - lo))
    trace, top, left, right, _, _ = k.groups_over(scan[rows] - low, y[rows], begin, 0.15, 15, 100, 50)
    wide = np.flatnonzero(scan[rows[right]] - scan[rows[left]] > 20)
    least = np.array([0.03 * (y[i:j].max() - np.median(y[i : min(j, i + 100)])) if j > i else 0.0 for i, j in zip(lo.tolist(), hi.tolist())])
    inner = k.find_many([y[rows[left[g]] : rows[right[g]] + 1] for g in wide.tolist()], None, 10, least[trace[wide]])
    whole = np.delete(np.arange(len(trace)), np.unique(wide[inner.trace]))
    of = np.concatenate([trace[whole], trace[wide[inner.trace]]])
    return of, np.concatenate([rows[top[whole]], rows[left[wide[inner.trace]]] + inner.place])


def plate_standards(peaks: DataFrame, n: int = PLATE_RUN["n_standards"]) -> DataFrame:
    """Standard peaks of each well: those found that are no spikes (2.5 scans wide or more), the ``n`` tallest, of equals the later."""
    tallest = Window.partitionBy(*WELL).orderBy(F.desc("height"), F.desc("scan"))
    return peaks.where("top_width >= 2.5").withColumn("_k", F.row_number().over(tallest)).where(F.col("_k") <= n).select(*WELL, "scan", "height", "area")


def used_samples(samples: DataFrame, standards: DataFrame, limits: DataFrame, low: int = PLATE_RUN["match_low"], high: int = PLATE_RUN["match_high"]) -> DataFrame:
    """The sample peaks that count: without a lone first one (primer), over 2.5 and under the plate's limit (plate, limit) wide, and of these the ones matched to standards, each to one.

    Wells with fewer than two standards, or fewer than two matches, keep all that passed.
    """
    kept = pk.without_primer(samples, 30).join(limits, "plate").where((F.col("top_width") > 2.5) & (F.col("top_width") < F.col("limit"))).select(*pk.BY_CHANNEL, "scan", "height", "area")

    def run(key: tuple, s: pa.Table, p: pa.Table) -> pa.Table:
        near = {x for _, x in k.matched_before(s.column("scan").to_pylist(), p.column("scan").to_pylist(), low, high)} if s.num_rows >= 2 else set()
        return p.filter(pa.array([x in near for x in p.column("scan").to_pylist()], pa.bool_())) if len(near) >= 2 else p

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return by_group(standards.select(*WELL, "scan"), kept, WELL, run, schema, arrow=True)


def plate_run(trace: DataFrame, low: int = PLATE_RUN["scan_start"], high: int = PLATE_RUN["scan_end"], standard: str = "c3", sample: str = "c2") -> DataFrame:
    """Whole plates from traces: grade, then each well's standards, sample peaks, Gaussian fits, mutant fraction and areas over those of the nearest standard.

    Peaks are sought in [low, high), widths of single peaks in the whole trace. The grade rests on all wells of a plate, so that reruns
    agree. Rows: plate, well, grade, n_peaks, mf, status, scans (of the fits), norm_areas (0 without a standard); wells that end before ``low`` are left out.
    """
    # One row a well, whose single array all readers below share: so the traces are gone through once.
    item = F.struct("kind", "scan", "height", "area", "fwhm", "top_width")
    wells = _well_peaks(trace, low, high, standard, sample).groupBy(*WELL).agg(F.collect_list(item).alias("found")).where(F.size("found") > 0)
    of = lambda kind: wells.select(*WELL, F.inline(F.filter("found", lambda x: x["kind"] == kind)))
    graded = plate_quality(of("standard"), of("narrow"), wells)
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in gt.FWHM_LIMITS.items() for x in kv]), F.col("grade"))
    standards = plate_standards(of("standard"))
    used = used_samples(of("sample").withColumn("channel", F.lit(sample)), standards, graded.select("plate", limit.alias("limit")))
    # The fit's region counts its scans from its start.
    moved = lambda d, by: d.withColumn("scan", F.col("scan") + by)
    region = sg.to_long(trace.where((F.col("scan") >= low) & (F.col("scan") < high)), [sample])
    # The fit is the dear step and is read by two aggregates: its few rows go by well.
    item = F.struct((F.col("scan") + low).alias("scan"), "height", "area")
    fitted = pk.deconvolve(moved(region, -low), moved(used, -low), smooth=7).repartition(*WELL).groupBy(*WELL).agg(F.array_sort(F.collect_list(item)).alias("p"))
    std = standards.groupBy(*WELL).agg(F.array_sort(F.collect_list(F.struct("scan", "area"))).alias("s"))
    near = lambda x: F.array_min(F.transform("s", lambda s: F.struct(F.abs(s["scan"] - x["scan"]).alias("d"), s["scan"].alias("at"), s["area"].alias("area"))))["area"]
    d = wells.select(*WELL).join(graded.select("plate", "grade"), "plate").join(fitted, WELL, "left").join(std, WELL, "left")
    d = d.withColumn("norm_areas", F.transform("p", lambda x: F.when(near(x).isNotNull(), x["area"] / F.greatest(near(x), F.lit(1.0))).otherwise(0.0)))
    calls = gt.mutant_fraction(fitted.select(*WELL, F.inline("p")))
    none = F.expr("cast(array() as array<double>)")
    return d.join(calls, WELL, "left").select(
        *WELL, "grade", F.coalesce("n_peaks", F.lit(0)).cast("long").alias("n_peaks"), F.coalesce("mf", F.lit(0.0)).alias("mf"), F.coalesce("status", F.lit("no peaks")).alias("status"),
        F.coalesce(F.col("p.scan"), none).alias("scans"), F.coalesce("norm_areas", none).alias("norm_areas"),
    )


def _tallest(long: DataFrame) -> DataFrame:
    """Number, place and height of the tallest (first of equals) of a channel's peaks over max(50, 3 noise), half of it in prominence."""

    def run(t: pa.Table, begin: np.ndarray) -> dict[str, np.ndarray]:
        traces = np.split(t.column("y").to_numpy().astype(float), begin[1:-1])
        least = np.array([max(50.0, 3 * float((y[:NOISE_SCANS] if len(y) > NOISE_SCANS else y).std())) for y in traces])
        p, n = k.find_many(traces, least, 5, least / 2, 1), len(traces)
        h = p.y[p.at]
        order = np.lexsort((p.at, -h, p.trace))
        order = order[np.append(True, np.diff(p.trace[order]) > 0)[: len(order)]]
        place, height = np.zeros(n, int), np.zeros(n)
        place[p.trace[order]], height[p.trace[order]] = t.column("scan").to_numpy()[begin[p.trace[order]] + p.place[order]], h[order]
        return {"trace": np.arange(n), "n_peaks": np.bincount(p.trace, minlength=n), "max_peak_scan": place, "max_peak_height": height}

    return pk.by_trace(long, pk.BY_CHANNEL, run, "n_peaks long, max_peak_scan long, max_peak_height double")


def compact_features(trace: DataFrame, standards: DataFrame, n: int = 4) -> DataFrame:
    """32 features of each well: the standard's places and heights, five statistics and the tallest peak of two channels, the standard channel's level, ratios.

    ``standards``: plate, well, scan. A well with fewer than two of them has zeros there. Ratios count where the second channel exceeds 10.
    """
    at = standards.select(*WELL, "scan").join(trace.select(*WELL, "scan", "c2", "c3"), [*WELL, "scan"], "left").withColumn("h", F.coalesce("c3", F.lit(0.0)))
    ratio = F.when(F.col("c2") > 10, F.col("c3") / F.col("c2"))
    s = at.groupBy(*WELL).agg(
        F.array_sort(F.collect_list(F.struct("scan", "h"))).alias("p"), F.count(F.lit(1)).cast("double").alias("is_n"), (F.max("scan") - F.min("scan")).cast("double").alias("is_spread"),
        F.avg("h").alias("is_mean_height"), F.avg(ratio).alias("is_ratio_mean"), F.min(ratio).alias("is_ratio_min"),
    ).where("is_n >= 2")
    slot = {f"is_{i}_{name}": F.try_element_at("p", F.lit(i))[c].cast("double") for i in range(1, n + 1) for name, c in (("scan", "scan"), ("height", "h"))}
    s = s.withColumns(slot).drop("p")
    level = []
    for c in ("c1", "c2"):
        level += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.sum(F.col(c) * F.col(c)).alias(f"{c}_energy")]
    noise = F.when(F.count("c3") > NOISE_SCANS, F.stddev_pop(F.when(F.col("scan") < NOISE_SCANS, F.col("c3")))).otherwise(F.greatest(F.stddev_pop("c3"), F.lit(1e-10)))
    stats = trace.groupBy(*WELL).agg(*level, F.avg("c3").alias("c3_mean"), F.stddev_pop("c3").alias("c3_std"), noise.alias("c3_noise"))
    figures = ("n_peaks", "max_peak_scan", "max_peak_height")
    of = lambda c, f: F.max(F.when(F.col("channel") == c, F.col(f))).cast("double").alias(f"{c}_{f}")
    tall = _tallest(sg.to_long(trace, ["c1", "c2"])).groupBy(*WELL).agg(*[of(c, f) for c in ("c1", "c2") for f in figures])
    d = stats.join(tall, WELL, "left").join(s, WELL, "left")
    return d.select(*WELL, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in d.columns if c not in WELL])
