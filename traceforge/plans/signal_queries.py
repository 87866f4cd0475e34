"""Queries of the signal operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stencils as st
from ..operators import signal as sg
from ..schema import DETECTOR, DISPLAY_MATRIX, SMOOTH_WINDOW, SPECTRAL_MATRIX, WIDTH_HEIGHT
from . import views as v
from .peak_sql import edges, finder
from .views import TR, lg, sql

W = "WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan)"


def _rounded(d: DataFrame, *columns: str, to: int = 4) -> DataFrame:
    return d.withColumns({c: F.round(c, to) for c in columns})


def trace_wide(spark: SparkSession, sf: str) -> DataFrame:
    """D1: traces."""
    return _rounded(v.trace(spark, sf), "c3", "c4")


def trace_long_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-2: wide to long."""
    return _rounded(v.long(spark, sf), "y")


def trace_pivot_back(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-2: long to wide."""
    return _rounded(sg.to_wide(v.long(spark, sf)), "c1", "c2", "c3", "c4")


def noise_level(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-1."""
    return _rounded(sg.noise_level(v.long(spark, sf)), "noise")


def baseline_first200(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-3."""
    return _rounded(sg.first_median_baseline(v.long(spark, sf, ("c1", "c2"))), "y", "baseline", "corrected")


def baseline_first200_whole(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-3 with the integer form of older traces."""
    return _rounded(sg.first_median_baseline(v.long(spark, sf, ("c1",)), whole_numbers=True), "corrected")


def baseline_rolling_min(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-4, window 50."""
    return _rounded(sg.rolling_min_baseline(v.long(spark, sf), 50), "y", "baseline", "corrected")


def savgol_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-6, window 7."""
    return _rounded(sg.smooth(v.long(spark, sf, ("c1", "c2")), 7), "smooth", to=3)


def savgol_smooth_11(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-6, window 11."""
    return _rounded(sg.smooth(v.long(spark, sf, ("c1",)), 11), "smooth", to=3)


def _savgol_sql(width: int, *channels: str) -> str:
    taps = _savgol_expr(width)
    return sql(f"SELECT plate, well, channel, scan, y, round({taps}, 3) AS smooth FROM q {W}", TR, lg(*channels), "q AS (SELECT *, count(*) OVER (PARTITION BY plate, well, channel) AS n FROM lg)")


def _savgol_expr(width: int) -> str:
    rows, half = st.fit_rows(width), width // 2
    at = lambda k: "y" if k == 0 else f"lead(y, {k}) OVER w" if k > 0 else f"lag(y, {-k}) OVER w"
    taps = lambda i, shift: " + ".join(f"({float(rows[i, j])!r}) * {at(j - shift)}" for j in range(width))
    ends = "".join(f" WHEN scan = {i} THEN {taps(i, i)} WHEN scan = n - 1 - {i} THEN {taps(width - 1 - i, width - 1 - i)}" for i in range(half))
    return f"CASE WHEN n < {width} THEN y{ends} ELSE {taps(half, half)} END"


def mad_attenuate(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-7."""
    return _rounded(sg.attenuate_outliers(v.long(spark, sf, ("c1",))), "clipped")


def spectral_unmix(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-8."""
    return _rounded(sg.unmix(v.trace(spark, sf), SPECTRAL_MATRIX), "d1", "d2", "d3", "d4", to=3).select("plate", "well", "scan", "d1", "d2", "d3", "d4")


def _unmix_exprs(matrix) -> list[str]:
    m = np.linalg.inv(np.array(matrix, float))
    return ["greatest(" + " + ".join(f"({float(m[i, j])!r}) * c{j + 1}" for j in range(4)) + ", 0.0)" for i in range(4)]


def current_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-10."""
    return _rounded(sg.normalise_current(v.trace(spark, sf)), "scan_pos").select("plate", "well", "scan", "scan_pos")


def align_shift(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-11: by the left edge of the tallest peak that the detector finds in any channel."""
    from ..operators.peaks import detect_default

    d = sg.align_to_left_edge(v.trace(spark, sf), detect_default(v.long(spark, sf)))
    return _rounded(d, "shift", "scan_pos").select("plate", "well", "scan", "shift", "scan_pos")


def align_tallest_sample(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-11 in its plain form: by the greatest sample."""
    return sg.align_to_peak(v.trace(spark, sf), "c1").select("plate", "well", "scan", "shift", "scan_pos")


def transform_chain(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-12: norm, then align by the left edge on the normed axis, then unmix, on the pristine trace."""
    from ..operators.runs import transformed

    d = transformed(v.trace(spark, sf), matrix=DISPLAY_MATRIX)
    return _rounded(d, "scan_pos", "d1", "d2", to=3).select("plate", "well", "scan", "scan_pos", "d1", "d2")


def resample_grid(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-9: linear resampling to 128 points."""
    return _rounded(sg.resample(v.long(spark, sf, ("c1", "c3")), 128), "y")


def max_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-16."""
    return _rounded(sg.by_maximum(v.long(spark, sf, ("c1", "c2"))), "scaled", to=6)


def window_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-13 and PRE-14: windows of 31 around all peaks of a well, z-scored; their middle and first values."""
    places = v.peaks(spark, sf).select("plate", "well", F.col("scan").alias("position"))
    d = sg.windows(v.trace(spark, sf), places, 15, ["c1", "c3"])
    z = {c: sg.zscored(F.col(f"x_{c}")) for c in ("c1", "c3")}
    return d.select("plate", "well", "position", *[F.round(F.get(z[c], F.lit(i)), 4).alias(f"{c}_{n}") for c in z for i, n in ((15, "mid"), (0, "first"))])


def shift_augment(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-15: windows moved by -4 and 4 places, zeros moving in; the sum of what stays."""
    places = v.peaks(spark, sf).select("plate", "well", F.col("scan").alias("position"))
    d = sg.windows(v.trace(spark, sf), places, 15, ["c1"])
    total = lambda k: F.round(F.aggregate(sg.shifted(F.col("x_c1"), k), F.lit(0.0), lambda s, x: s + x), 2)
    return d.select("plate", "well", "position", total(-4).alias("minus_4"), total(4).alias("plus_4"))


def display_markers(spark: SparkSession, sf: str) -> DataFrame:
    """2.12: what the viewer draws."""
    from ..sources.sinks import display_rows

    return _rounded(display_rows(v.trace(spark, sf)), "marker").select("plate", "well", "scan", "current_10", "marker")


def als_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-5: iterative, tested against a dense solver."""
    return _rounded(sg.als_baseline(v.long(spark, sf, ("c1",)), 1e5), "baseline", "corrected", to=3)


#: The smoothed channels, the default detector's peaks, and the left edge of each well's tallest.
EDGE = [
    lg(), "q AS (SELECT *, count(*) OVER (PARTITION BY plate, well, channel) AS n FROM lg)",
    f"ss AS MATERIALIZED (SELECT plate, well, channel, scan AS pos, y, {_savgol_expr(SMOOTH_WINDOW)} AS s FROM q {W})",
    *finder("ss", "fp", str(DETECTOR["height"]), DETECTOR["distance"], str(DETECTOR["prominence"]), DETECTOR["min_width"]),
    f"ed AS MATERIALIZED (SELECT plate, well, {edges(WIDTH_HEIGHT)[0]} AS spot FROM (SELECT fp.*, row_number() OVER (PARTITION BY fp.plate, fp.well ORDER BY y DESC, fp.pos, fp.channel) AS k FROM fp JOIN ss USING (plate, well, channel, pos)) WHERE k = 1)",
]
P5 = "p5 AS (SELECT *, 1 AS k FROM pk)"
UN = _unmix_exprs(SPECTRAL_MATRIX)
UD = _unmix_exprs(DISPLAY_MATRIX)

QUERIES: v.Queries = {
    "trace_wide": (trace_wide, sql("SELECT plate, well, scan, c1, c2, round(c3, 4) AS c3, round(c4, 4) AS c4, current FROM tr", TR)),
    "trace_long_unpivot": (trace_long_unpivot, sql("SELECT plate, well, channel, scan, round(y, 4) AS y FROM lg", TR, lg())),
    "trace_pivot_back": (trace_pivot_back, sql("SELECT plate, well, scan, round(c1, 4) AS c1, round(c2, 4) AS c2, round(c3, 4) AS c3, round(c4, 4) AS c4 FROM tr", TR)),
    "noise_level": (noise_level, sql("SELECT plate, well, channel, round(CASE WHEN count(*) > 200 THEN greatest(stddev_pop(y) FILTER (WHERE scan < 200), 1e-10) ELSE greatest(stddev_pop(y), 1.0) END, 4) AS noise FROM lg GROUP BY ALL", TR, lg())),
    "baseline_first200": (baseline_first200, sql("SELECT lg.plate, lg.well, lg.channel, scan, round(y, 4) AS y, round(m, 4) AS baseline, round(y - m, 4) AS corrected FROM lg JOIN b USING (plate, well, channel)", TR, lg("c1", "c2"), "b AS (SELECT plate, well, channel, quantile_cont(y, 0.5) FILTER (WHERE scan < 200) AS m FROM lg GROUP BY ALL)")),
    "baseline_first200_whole": (baseline_first200_whole, sql("SELECT lg.plate, lg.well, lg.channel, scan, y, floor(m) AS baseline, round(y - floor(m), 4) AS corrected FROM lg JOIN b USING (plate, well, channel)", TR, lg("c1"), "b AS (SELECT plate, well, channel, quantile_cont(y, 0.5) FILTER (WHERE scan < 200) AS m FROM lg GROUP BY ALL)")),
    "baseline_rolling_min": (baseline_rolling_min, sql("SELECT plate, well, channel, scan, round(y, 4) AS y, round(min(y) OVER w, 4) AS baseline, round(y - min(y) OVER w, 4) AS corrected FROM lg WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)", TR, lg())),
    "savgol_smooth": (savgol_smooth, _savgol_sql(7, "c1", "c2")),
    "savgol_smooth_11": (savgol_smooth_11, _savgol_sql(11, "c1")),
    "mad_attenuate": (mad_attenuate, sql("SELECT plate, well, channel, scan, y, round(least(greatest(y, m - 5 * (d + 1e-8)), m + 5 * (d + 1e-8)), 4) AS clipped FROM (SELECT *, list_median(list_transform(a, lambda x: abs(x - m))) AS d FROM q)", TR, lg("c1"), "q AS (SELECT *, list(y) OVER w AS a, quantile_cont(y, 0.5) OVER w AS m FROM lg WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING))")),
    "spectral_unmix": (spectral_unmix, sql("SELECT plate, well, scan, " + ", ".join(f"round({e}, 3) AS d{i + 1}" for i, e in enumerate(UN)) + " FROM tr", TR)),
    "current_normalize": (current_normalize, sql("SELECT tr.plate, tr.well, scan, round(scan * CASE WHEN own <> 0 THEN own / mid ELSE 1 END, 4) AS scan_pos FROM tr JOIN p USING (plate, well)", TR, "p AS (SELECT plate, well, own, avg(own) OVER (PARTITION BY plate) AS mid FROM (SELECT plate, well, avg(current) AS own FROM tr GROUP BY ALL))")),
    "align_shift": (align_shift, sql("SELECT tr.plate, tr.well, scan, round(coalesce(s, 0), 4) AS shift, round(scan + coalesce(s, 0), 4) AS scan_pos FROM tr LEFT JOIN h USING (plate, well)", TR, *EDGE, "h AS (SELECT plate, well, quantile_cont(spot, 0.5) OVER (PARTITION BY plate) - spot AS s FROM ed)")),
    "align_tallest_sample": (align_tallest_sample, sql("SELECT tr.plate, tr.well, scan, s AS shift, scan + s AS scan_pos FROM tr JOIN h USING (plate, well)", TR, "g AS (SELECT plate, well, scan AS spot FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY c1 DESC, scan) AS k FROM tr) WHERE k = 1)", "h AS (SELECT plate, well, quantile_cont(spot, 0.5) OVER (PARTITION BY plate) - spot AS s FROM g)")),
    "transform_chain": (transform_chain, sql(f"SELECT tr.plate, tr.well, scan, round(scan * f + coalesce(s, 0), 3) AS scan_pos, round({UD[0]}, 3) AS d1, round({UD[1]}, 3) AS d2 FROM tr JOIN p USING (plate, well) LEFT JOIN h USING (plate, well)", TR, *EDGE, "p AS (SELECT plate, well, CASE WHEN own <> 0 THEN own / avg(own) OVER (PARTITION BY plate) ELSE 1 END AS f FROM (SELECT plate, well, avg(current) AS own FROM tr GROUP BY ALL))", "h AS (SELECT plate, well, quantile_cont(spot * f, 0.5) OVER (PARTITION BY plate) - spot * f AS s FROM ed JOIN p USING (plate, well))")),
    "resample_grid": (resample_grid, sql("SELECT g.plate, g.well, g.channel, i AS point, round(a.y + (coalesce(b.y, a.y) - a.y) * ((i * greatest(n - 1, 1) - (i * greatest(n - 1, 1)) // 127 * 127) / 127.0), 4) AS y FROM g JOIN lg a ON a.plate = g.plate AND a.well = g.well AND a.channel = g.channel AND a.scan = (i * greatest(n - 1, 1)) // 127 LEFT JOIN lg b ON b.plate = g.plate AND b.well = g.well AND b.channel = g.channel AND b.scan = a.scan + 1", TR, lg("c1", "c3"), "g AS (SELECT plate, well, channel, n, i FROM (SELECT plate, well, channel, count(*) AS n FROM lg GROUP BY ALL), range(0, 128) t(i))")),
    "max_normalize": (max_normalize, sql("SELECT plate, well, channel, scan, y, round(CASE WHEN m > 0 THEN y / m ELSE y END, 6) AS scaled FROM (SELECT *, max(y) OVER (PARTITION BY plate, well, channel) AS m FROM lg)", TR, lg("c1", "c2"))),
    "window_zscore": (window_zscore, sql("SELECT plate, well, scan AS position, " + ", ".join(f"round(({e} - avg({c}) OVER f) / (stddev_pop({c}) OVER f + 1e-8), 4) AS {c}_{n}" for c in ("c1", "c3") for e, n in ((c, "mid"), (f"first_value({c}) OVER f", "first"))) + ", n, k FROM (SELECT tr.*, count(*) OVER (PARTITION BY plate, well) AS n, p5.k FROM tr LEFT JOIN p5 USING (plate, well, scan)) WINDOW f AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)", TR, lg("c1"), v.PK, P5)),
    "shift_augment": (shift_augment, sql("SELECT plate, well, scan AS position, round(sum(c1) OVER f1, 2) AS minus_4, round(sum(c1) OVER f2, 2) AS plus_4, n, k FROM (SELECT tr.*, count(*) OVER (PARTITION BY plate, well) AS n, p5.k FROM tr LEFT JOIN p5 USING (plate, well, scan)) WINDOW f1 AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 11 PRECEDING AND 15 FOLLOWING), f2 AS (PARTITION BY plate, well ORDER BY scan ROWS BETWEEN 15 PRECEDING AND 11 FOLLOWING)", TR, lg("c1"), v.PK, P5)),
    "display_markers": (display_markers, sql("SELECT plate, well, scan, current / 10 AS current_10, round(c1 + 0.03 * (max(c1) OVER w - min(c1) OVER w), 4) AS marker FROM tr WINDOW w AS (PARTITION BY plate, well)", TR)),
    "als_baseline": (als_baseline, None),
}
for _n in ("window_zscore", "shift_augment"):
    _f, _s = QUERIES[_n]
    _head, _cut, _tail = _s.rpartition("\nSELECT plate, well, scan AS position")
    QUERIES[_n] = (_f, f"{_head}\nSELECT * EXCLUDE (n, k) FROM (SELECT plate, well, scan AS position{_tail}) WHERE k IS NOT NULL AND position >= 15 AND position < n - 15")
