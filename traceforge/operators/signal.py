"""Signal pre-processing over traces (plate, well, scan, c1..c4, current) and their long form (channel, y).

All but the iterative baseline are window expressions: one exchange by well. Empty traces give no
rows; null samples stay null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stencils as st
from ..schema import ALS_P, ALS_ROUNDS, CHANNELS, NOISE_SCANS, WELL


def to_long(trace: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """One row per scan and channel. The rows are made in place, so that wells stay where an exchange has put them."""
    samples = F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("y")) for c in channels]))
    return trace.select(*WELL, "scan", samples if len(channels) > 1 else F.lit(channels[0]).alias("channel"), *([] if len(channels) > 1 else [F.col(channels[0]).alias("y")]))


def to_wide(long: DataFrame, channels: list[str] = CHANNELS) -> DataFrame:
    """One row per scan; the channel names are given, so no extra job looks for them."""
    return long.groupBy(*WELL, "scan").pivot("channel", channels).agg(F.first("y"))


def noise_level(long: DataFrame, first: int = NOISE_SCANS, short: str = "std") -> DataFrame:
    """Noise of each channel: population deviation of the first scans; of traces no longer than that, ``short``: std of all or 'one'."""
    head = F.stddev_pop(F.when(F.col("scan") < first, F.col("y")))
    other = F.greatest(F.stddev_pop("y"), F.lit(1.0)) if short == "std" else F.lit(1.0)
    return long.groupBy(*WELL, "channel").agg(F.when(F.count("y") > first, F.greatest(head, F.lit(1e-10))).otherwise(other).alias("noise"))


def first_median_baseline(long: DataFrame, first: int = NOISE_SCANS, whole_numbers: bool = False) -> DataFrame:
    """Subtract the median of the first scans. ``whole_numbers`` cuts it to an integer, as integer arrays do."""
    base = F.percentile(F.when(F.col("scan") < first, F.col("y")), F.lit(0.5)).over(st.whole("channel"))
    base = F.floor(base) if whole_numbers else base
    return long.withColumn("baseline", base.cast("double")).withColumn("corrected", F.col("y") - F.col("baseline"))


def rolling_min_baseline(long: DataFrame, width: int) -> DataFrame:
    """Subtract the least value around each scan."""
    return long.withColumn("baseline", st.rolling_min(F.col("y"), width, st.scans("channel"))).withColumn("corrected", F.col("y") - F.col("baseline"))


def als_curve(y: np.ndarray, lam: float, p: float = ALS_P, rounds: int = ALS_ROUNDS) -> np.ndarray:
    """Asymmetric least squares: a smooth curve below the signal. The normal matrix has five diagonals and is factored in place."""
    n = len(y)
    if n < 3:
        return y.astype(float)
    d = np.zeros((3, n))  # lam * second differences' square: main diagonal and the two above it
    for k, c in ((0, 1.0), (1, -2.0), (2, 1.0)):
        d[0, k : n - 2 + k] += lam * c * c
    d[1, : n - 1] = lam * np.array([-2.0, *[-4.0] * (n - 3), -2.0][: n - 1]) if n > 2 else 0
    d[2, : n - 2] = lam
    w, z = np.ones(n), y
    for _ in range(rounds):
        a, b, c, rhs = (d[0] + w).tolist(), d[1].tolist(), d[2].tolist(), (w * y).tolist()
        # Root-free Cholesky of a symmetric band of width two.
        for i in range(n):
            if i + 1 < n:
                f = b[i] / a[i]
                a[i + 1] -= f * b[i]
                if i + 2 < n:
                    b[i + 1] -= f * c[i]
                    g = c[i] / a[i]
                    a[i + 2] -= g * c[i]
                    rhs[i + 2] -= g * rhs[i]
                rhs[i + 1] -= f * rhs[i]
        x = [0.0] * n
        for i in range(n - 1, -1, -1):
            v = rhs[i] - (b[i] * x[i + 1] if i + 1 < n else 0.0) - (c[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] = v / a[i]
        z = np.array(x)
        w = p * (y > z) + (1 - p) * (y < z)
    return z


def als_baseline(long: DataFrame, lam: float) -> DataFrame:
    """Subtract an asymmetric least-squares curve; iterative, so a trace is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan")
        z = als_curve(pdf["y"].to_numpy(float), lam)
        return pdf.assign(baseline=z, corrected=pdf["y"] - z)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*WELL, "channel", "scan", "y").schema)
    return long.select(*WELL, "channel", "scan", "y").groupBy(*WELL, "channel").applyInPandas(run, f"{schema}, baseline double, corrected double")


def smooth(long: DataFrame, width: int = 7) -> DataFrame:
    """Savitzky-Golay of order 2."""
    w, n = st.scans("channel"), F.count(F.lit(1)).over(st.whole("channel"))
    return long.withColumn("smooth", st.savgol(F.col("y"), width, w, n))


def attenuate_outliers(long: DataFrame, width: int = 51, threshold: float = 5.0) -> DataFrame:
    """Clip each sample to its window's median, give or take a multiple of the window's median deviation."""
    around = F.sort_array(F.collect_list("y").over(st.scans("channel").rowsBetween(-(width // 2), width // 2)))
    found = long.withColumn("_a", around).withColumn("_m", st.middle(F.col("_a")))
    spread = st.middle(F.sort_array(F.transform("_a", lambda x: F.abs(x - F.col("_m"))))) + 1e-8
    found = found.withColumn("_d", spread * threshold)
    return found.withColumn("clipped", F.least(F.greatest(F.col("y"), F.col("_m") - F.col("_d")), F.col("_m") + F.col("_d"))).drop("_a", "_m", "_d")


def unmix(trace: DataFrame, matrix, channels: list[str] = CHANNELS, names: tuple[str, ...] = ("d1", "d2", "d3", "d4")) -> DataFrame:
    """Dye intensities from channels; the matrix is inverted on the driver."""
    return trace.withColumns(dict(zip(names, st.unmixed(channels, matrix))))


def normalise_current(trace: DataFrame) -> DataFrame:
    """Scale a well's scan axis by its mean current over the plate's mean of such means; a mean of 0 leaves it."""
    by_well = trace.groupBy(*WELL).agg(F.avg("current").alias("_own"))
    by_plate = by_well.withColumn("_plate", F.avg("_own").over(Window.partitionBy("plate")))
    factor = F.when(F.col("_own") != 0, F.coalesce(F.try_divide("_own", "_plate"), F.lit(1.0))).otherwise(1.0)
    return trace.join(by_plate, WELL).withColumn("scan_pos", F.col("scan") * factor).drop("_own", "_plate")


def align_to_peak(trace: DataFrame, channel: str) -> DataFrame:
    """Shift each well so that its greatest sample (the first of equals) stands at the plate's median place: a plain form of ``align_to_left_edge`` without a detector."""
    place = trace.groupBy(*WELL).agg(F.max(F.struct(F.col(channel), (-F.col("scan")).alias("s"))).alias("_t")).select(*WELL, (-F.col("_t.s")).alias("_place"))
    shift = place.withColumn("shift", F.percentile("_place", F.lit(0.5)).over(Window.partitionBy("plate")) - F.col("_place")).select(*WELL, "shift")
    return trace.join(shift, WELL).withColumn("scan_pos", F.col("scan") + F.col("shift"))


def align_to_left_edge(trace: DataFrame, peaks: DataFrame, place: str = "scan") -> DataFrame:
    """Shift each well so that the left edge of its tallest peak stands at the plate's median of such edges.

    ``peaks``: plate, well, channel, scan, height, and ``left_at``, the edge in scans from the trace's start, between two of which the
    column ``place`` is interpolated. Of equal heights the lower scan counts, then the first channel. Wells without peaks stay where they are (shift 0).
    """
    top = peaks.groupBy(*WELL).agg(F.max_by("left_at", F.struct("height", (-F.col("scan")).alias("s"), (-F.substring("channel", 2, 9).cast("int")).alias("c"))).alias("_edge"))
    w = st.scans()
    ends = trace.select(*WELL, F.col("scan").alias("_scan"), F.col(place).cast("double").alias("_at"), F.coalesce(F.lead(F.col(place).cast("double")).over(w), F.col(place)).alias("_next"))
    edge = top.withColumn("_scan", F.floor("_edge")).join(ends, [*WELL, "_scan"]).withColumn("_left", F.col("_at") + (F.col("_next") - F.col("_at")) * (F.col("_edge") - F.col("_scan")))
    shift = edge.withColumn("shift", F.percentile("_left", F.lit(0.5)).over(Window.partitionBy("plate")) - F.col("_left")).select(*WELL, "shift")
    d = trace.join(shift, WELL, "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    return d.withColumn("scan_pos", F.col(place) + F.col("shift"))


def resample(long: DataFrame, points: int) -> DataFrame:
    """Linear interpolation on ``points`` places from the first scan to the last: each gap makes the places inside it, without a join."""
    w = st.scans("channel")
    d = long.withColumn("_n", F.count(F.lit(1)).over(st.whole("channel"))).withColumn("_next", F.coalesce(F.lead("y").over(w), F.col("y")))
    span, steps = F.greatest(F.col("_n") - 1, F.lit(1)), points - 1
    begin, end = F.ceil(F.col("scan") * steps / span), F.ceil((F.col("scan") + 1) * steps / span) - 1
    end = F.when(F.col("scan") == F.col("_n") - 1, F.lit(steps)).otherwise(F.least(end, F.lit(steps)))
    d = d.where(begin <= end).withColumn("point", F.explode(F.sequence(begin.cast("long"), end.cast("long"))))
    part = (F.col("point") * span - F.col("scan") * steps) / steps
    return d.select(*WELL, "channel", "point", (F.col("y") + (F.col("_next") - F.col("y")) * part).alias("y"))


def by_maximum(long: DataFrame) -> DataFrame:
    """Divide by the channel's greatest value where that is positive."""
    top = F.max("y").over(st.whole("channel"))
    return long.withColumn("scaled", F.when(top > 0, F.col("y") / top).otherwise(F.col("y")))


def windows(trace: DataFrame, positions: DataFrame, radius: int, channels: list[str] = CHANNELS) -> DataFrame:
    """Samples around positions (plate, well, position) that lie wholly inside the trace: an array per channel.

    A well's samples meet its positions as two arrays of one row, and each window is a slice: no scan without a position makes a window, and
    nothing is joined by scan. Scans count from 0 without gaps.
    """
    width = 2 * radius + 1
    wells = trace.groupBy(*WELL).agg(F.array_sort(F.collect_list(F.struct("scan", *channels))).alias("_t")).withColumn("_n", F.size("_t"))
    rest = [c for c in positions.columns if c not in (*WELL, "position")]
    wanted = positions.groupBy(*WELL).agg(F.collect_list(F.struct("position", *rest)).alias("_p"))
    inside = F.filter("_p", lambda p: (p["position"] >= radius) & (p["position"] < F.col("_n") - radius))
    around = lambda p, c: F.transform(F.slice(F.col("_t"), (p["position"] - radius + 1).cast("int"), F.lit(width)), lambda x: x[c])
    cut = F.transform(inside, lambda p: F.struct(p["position"].alias("position"), *[p[c].alias(c) for c in rest], *[around(p, c).alias(f"x_{c}") for c in channels]))
    return wells.join(wanted, WELL).select(*WELL, F.inline(cut))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def zscored(x: Column) -> Column:
    """An array's values less their mean, over their population deviation and 1e-8."""
    n, total = F.size(x), lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return _let(total(x) / n, lambda m: _let(F.sqrt(total(F.transform(x, lambda u: (u - m) * (u - m))) / n) + 1e-8, lambda d: F.transform(x, lambda v: (v - m) / d)))


def shifted(x: Column, by: int) -> Column:
    """An array moved by some places, zeros moving in."""
    n = F.size(x)
    zeros = F.array_repeat(F.lit(0.0), abs(by))
    return F.concat(zeros, F.slice(x, 1, n - by)) if by > 0 else F.concat(F.slice(x, 1 - by, n + by), zeros) if by < 0 else x
