"""Peaks: detection, grouping, refinement, areas, filters and edits.

Peak rows are (plate, well, channel, scan, height, ...). Detection streams sorted partitions, many whole traces at a time; the greedy
suppression of given peaks is a grouped function; the rest are window expressions and joins. Empty traces have no peaks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as k
from ..functions import stencils as st
from ..schema import BASE_DETECT, CHANNELS, DETECTOR, MOBILITY_OFFSETS, NOISE_SCANS, SMOOTH_WINDOW, WELL, WIDTH_HEIGHT
from . import signal
from .joins import by_group, range_join

BY_CHANNEL = [*WELL, "channel"]


def local_maxima(long: DataFrame, y: str = "y") -> DataFrame:
    """Strict local maxima, plateaus at their middle: runs of equal samples, each compared with the runs beside it."""
    w = st.scans("channel")
    new = F.coalesce(F.lag(y).over(w) != F.col(y), F.lit(True))
    runs = long.withColumn("_new", new).withColumn("_last", F.max("scan").over(st.whole("channel"))).where("_new")
    before, after, begin = F.lag(y).over(w), F.lead(y).over(w), F.lead("scan").over(w)
    found = runs.withColumns({"_b": before, "_a": after, "_end": begin - 1}).where((F.col(y) > F.col("_b")) & (F.col(y) > F.col("_a")))
    return found.select(*BY_CHANNEL, F.floor((F.col("scan") + F.col("_end")) / 2).alias("scan"), F.col(y).alias("height"))


def _whole_traces(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of ``keys`` as tables of whole traces, with where each begins and the end."""
    held: list[pa.RecordBatch] = []

    def put(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for c in keys:
            code = t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return t, np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        # A batch that only carries the held trace on waits with it, so that a long trace is put together once.
        same = held and all(held[-1].column(c)[-1] == b.column(c)[b.num_rows - 1] for c in keys)
        held.append(b)
        if same:
            continue
        t, begin = put(pa.Table.from_batches(held))
        if len(begin) > 2:
            yield t.slice(0, begin[-2]), begin[:-1]
        held = t.slice(begin[-2]).combine_chunks().to_batches()
    if held:
        yield put(pa.Table.from_batches(held))


def by_trace(rows: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``run`` on tables of many whole traces (rows in scan order; where each begins, and the end): the columns of ``schema``, and ``trace``, the number of each row's trace in the table.

    A trace is all rows of equal ``keys``. Tasks stream their sorted partition, so a task holds a batch and a trace and no more.
    """
    kept = rows.select(*keys).schema
    names = [c.split()[0] for c in schema.split(", ")]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in _whole_traces(batches, keys):
            got = run(t, begin)
            of = pa.array(begin[:-1][got["trace"]])
            yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks().take(of) for c in keys], *[pa.array(got[c]) for c in names]], names=[*keys, *names])

    dealt = rows.repartition(*WELL).sortWithinPartitions(*keys, "scan")
    return dealt.mapInArrow(stream, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], schema]))


def _samples(t: pa.Table, begin: np.ndarray, column: str = "y") -> list[np.ndarray]:
    """Each trace's samples; missing ones are NaN."""
    return np.split(t.column(column).to_numpy().astype(float), begin[1:-1])


def _bounds(found: list[dict]) -> dict:
    """Settings of ``find_peaks`` by trace, one array each; what no trace bounds is left out."""
    out = {}
    for c in ("height", "distance", "prominence", "width"):
        values = [f.get(c) for f in found]
        if any(v is not None for v in values):
            out[c] = np.array([-np.inf if v is None else v for v in values], float)
    return out


def detect(long: DataFrame, height: float | None = None, prominence: float | None = None, distance: float | None = None, width: float | None = None,
           noise_factor: float | None = None, smooth: int = SMOOTH_WINDOW, baseline: Callable[[np.ndarray], np.ndarray] | None = None,
           scan_range: tuple[int, int] | None = None, stutter: int | None = None) -> DataFrame:
    """Peaks of each channel: baseline, noise, smoothing, the four filters, then the scan range, integration bounds and areas.

    ``noise_factor`` raises the height to that multiple of the noise. Rows: scan, height, prominence, width, left, right, baseline, area, noise, count (of merged peaks), left_at (the left edge before rounding, in places from the trace's start).
    """
    taps = st.fit_rows(smooth)

    def run(t: pa.Table, begin: np.ndarray) -> dict[str, np.ndarray]:
        scan, raw = t.column("scan").to_numpy(), _samples(t, begin)
        base = [baseline(y) for y in raw] if baseline else [np.zeros(len(y)) for y in raw]
        traces = [y - z for y, z in zip(raw, base)]
        noise = np.array([max(float(y[:NOISE_SCANS].std()), 1e-10) if len(y) > NOISE_SCANS else max(float(y.std()), 1.0) for y in traces])
        least = height if noise_factor is None else np.maximum(height or 0.0, noise_factor * noise)
        p = k.find_many([k.smoothed(y, taps) for y in traces], least, distance, prominence, width)
        if scan_range:
            at = scan[begin[p.trace] + p.place]
            p = p.where((at >= scan_range[0]) & (at <= scan_range[1]))
        p = p.with_valleys()
        _, lo, hi = p.widths(WIDTH_HEIGHT)
        row, y = begin[p.trace] + p.place, np.concatenate(traces)
        top, count, trace, prom = row, np.ones(len(row), int), p.trace, p.valleys[0]
        if stutter is not None and len(row):
            # Chains of peaks no farther apart than the window: the tallest, of equals the first, stands for all.
            new = np.append(True, (np.diff(trace) > 0) | (np.diff(row) > stutter))
            chain, start = np.cumsum(new) - 1, np.flatnonzero(new)
            order = np.lexsort((np.arange(len(row)), -y[row], chain))[start]
            lo, hi, count = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start), np.diff(np.append(start, len(row)))
            top, trace, prom = row[order], trace[order], prom[order]
        left, right = begin[trace] + np.maximum(0, np.rint(lo).astype(int)), np.minimum(begin[trace + 1] - 1, begin[trace] + np.rint(hi).astype(int))
        return {
            "trace": trace, "scan": scan[top], "height": y[top], "prominence": prom, "width": (right - left).astype(float), "left": scan[left].astype(float), "right": scan[right].astype(float),
            "baseline": np.concatenate(base)[top], "area": k.simpsons(y, left, right), "noise": noise[trace], "count": count, "left_at": lo,
        }

    schema = "scan long, height double, prominence double, width double, left double, right double, baseline double, area double, noise double, count long, left_at double"
    return by_trace(long.select(*BY_CHANNEL, F.col("scan").cast("long").alias("scan"), "y"), BY_CHANNEL, run, schema)


def found_peaks(long: DataFrame, settings: Callable[[np.ndarray], dict]) -> DataFrame:
    """Peaks of the raw samples by the bounds that ``settings`` sets for each trace (height, distance, prominence, width): scan, height, prominence, width at half prominence."""

    def run(t: pa.Table, begin: np.ndarray) -> dict[str, np.ndarray]:
        traces = _samples(t, begin)
        p = k.find_many(traces, **_bounds([settings(y) for y in traces])).with_valleys()
        return {"trace": p.trace, "scan": t.column("scan").to_numpy()[begin[p.trace] + p.place], "height": p.y[p.at], "prominence": p.valleys[0], "width": p.widths(0.5)[0]}

    return by_trace(long.select(*BY_CHANNEL, F.col("scan").cast("long").alias("scan"), "y"), BY_CHANNEL, run, "scan long, height double, prominence double, width double")


def top_widths(long: DataFrame, peaks: DataFrame, before: int, after: int) -> DataFrame:
    """``peaks`` with ``top_width``: the width at half prominence of the greatest sample (the first of equals) from ``before`` scans before to ``after`` scans after each, seen within these scans alone.

    A peak's scans come by a range join, and its few samples are one small array.
    """
    d = range_join(peaks, long.select(*BY_CHANNEL, F.col("scan").alias("_at"), "y"), BY_CHANNEL, "_at", F.col("scan") - before, F.col("scan") + after, before + after + 1)
    near = d.groupBy(*peaks.columns).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("y").cast("double").alias("y")))).alias("_s"))

    @F.pandas_udf("double")
    def width(samples: pd.Series) -> pd.Series:
        return pd.Series([float(k.widths(y, np.array([int(np.argmax(y))]), 0.5)[0][0]) for y in (np.asarray(x, float) for x in samples)])

    return near.withColumn("top_width", width(F.transform("_s", lambda x: x["y"]))).drop("_s")


def parted_groups(long: DataFrame, groups: DataFrame, wider_than: int, distance: int, share: float, head: int = 100) -> DataFrame:
    """Groups of scans (left, right; scan and height of the top) wider than a limit give way to the peaks in them that stand out by ``share`` of the trace's range over its head's median, if there are any."""

    def run(key: tuple, trace: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        trace, out = trace.sort_values("scan"), []
        scan, y = trace["scan"].to_numpy(), trace["y"].to_numpy(float)
        least = share * (y.max() - np.median(y[:head])) if len(y) else 0.0
        for g in found.sort_values("scan").itertuples():
            part = np.flatnonzero((scan >= g.left) & (scan <= g.right))
            inner = part[k.find_peaks(y[part], None, distance, least)] if g.right - g.left > wider_than else part[:0]
            out += [(scan[q], y[q]) for q in inner] if len(inner) else [(g.scan, g.height)]
        got = pd.DataFrame(out, columns=["scan", "height"])
        for c, v in zip(BY_CHANNEL, key):
            got[c] = v
        return got[[*BY_CHANNEL, "scan", "height"]]

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*BY_CHANNEL).schema)
    return by_group(long.select(*BY_CHANNEL, "scan", "y"), groups.select(*BY_CHANNEL, "scan", "height", "left", "right"), BY_CHANNEL, run, f"{keys}, scan long, height double")


def detect_default(long: DataFrame) -> DataFrame:
    """The interactive detector's defaults."""
    return detect(long, DETECTOR["height"], DETECTOR["prominence"], DETECTOR["distance"], DETECTOR["min_width"], scan_range=(DETECTOR["scan_start"], DETECTOR["scan_end"]))


def detect_for_bases(trace: DataFrame, offsets: tuple[int, ...] = MOBILITY_OFFSETS, height: float = BASE_DETECT["height"], prominence: float = BASE_DETECT["prominence"],
                     distance: float = BASE_DETECT["distance"], reach: float = BASE_DETECT["nms"], last_channel: bool = False) -> DataFrame:
    """Peaks of four channels, shifted by each one's mobility, then greedily thinned so that no two stand within ``reach``.

    A peak's channel is that of its winning candidate; ``last_channel`` names every peak at place 1 or later after the last
    channel instead, as older outputs do.
    """

    def run(t: pa.Table, begin: np.ndarray) -> dict[str, np.ndarray]:
        size = np.diff(begin)
        by_channel = []
        for c, (name, offset) in enumerate(zip(CHANNELS, offsets)):
            p = k.find_many(_samples(t, begin, name), height, distance, prominence)
            place = p.place + offset
            inside = (place >= 0) & (place < size[p.trace])
            by_channel.append((p.trace[inside], place[inside], p.y[p.at][inside], np.full(inside.sum(), c)))
        well, place, h, c = (np.concatenate(x) for x in zip(*by_channel))
        # Wells lie farther apart than the reach, so one thinning serves them all.
        keep = k.suppress(place + well * (size.max() + int(np.ceil(reach)) + 1), h, reach)
        named = np.where(place >= 1, len(CHANNELS) - 1, c) if last_channel else c
        return {"trace": well[keep], "channel": np.array(CHANNELS, object)[named[keep]], "scan": place[keep], "height": h[keep]}

    return by_trace(trace.select(*WELL, "scan", *CHANNELS), WELL, run, "channel string, scan long, height double")


def suppress_near(peaks: DataFrame, reach: float) -> DataFrame:
    """Greedy thinning of a well's peaks by height."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["scan", "channel"]).reset_index(drop=True)
        return pdf.iloc[k.suppress(pdf["scan"].to_numpy(), pdf["height"].to_numpy(), reach)]

    return peaks.groupBy(*WELL).applyInPandas(run, peaks.schema)


def stutter_groups(peaks: DataFrame, window: int) -> DataFrame:
    """Chains of peaks no farther apart than ``window``: the tallest (first of equals) stands for all; bounds and counts join."""
    w = st.scans("channel")
    new = (F.col("scan") - F.lag("scan").over(w) > window).cast("int")
    grouped = peaks.withColumn("_g", F.sum(F.coalesce(new, F.lit(0))).over(w))
    top = F.max(F.struct("height", (-F.col("scan")).alias("s")))
    return grouped.groupBy(*BY_CHANNEL, "_g").agg(
        top.alias("_t"), F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), F.count(F.lit(1)).alias("n_merged")
    ).select(*BY_CHANNEL, (-F.col("_t.s")).alias("scan"), F.col("_t.height").alias("height"), "first_scan", "last_scan", "n_merged")


def threshold_groups(long: DataFrame, ratio: float, gap: int, head: int = 100, least_range: float = 1.0) -> DataFrame:
    """Runs of scans above a threshold between the head's median and the top, parted at gaps over ``gap``; runs of one scan are dropped.

    Rows: scan of the top (first of equals), height, left, right, n_points, area (sum of samples).
    """
    stats = F.percentile(F.when(F.col("scan") < head, F.col("y")), F.lit(0.5)).over(st.whole("channel"))
    d = long.withColumn("_base", stats).withColumn("_top", F.max("y").over(st.whole("channel")))
    d = d.where((F.col("_top") - F.col("_base") >= least_range) & (F.col("y") > F.col("_base") + (F.col("_top") - F.col("_base")) * ratio))
    w = st.scans("channel")
    d = d.withColumn("_g", F.sum(F.coalesce((F.col("scan") - F.lag("scan").over(w) > gap).cast("int"), F.lit(0))).over(w))
    top = F.max(F.struct("y", (-F.col("scan")).alias("s"))).alias("_t")
    return (
        d.groupBy(*BY_CHANNEL, "_g").agg(top, F.min("scan").alias("left"), F.max("scan").alias("right"), F.count(F.lit(1)).alias("n_points"), F.sum("y").alias("area"))
        .where("n_points >= 2")
        .select(*BY_CHANNEL, (-F.col("_t.s")).alias("scan"), F.col("_t.y").alias("height"), "left", "right", "n_points", "area")
    )


def found_groups(long: DataFrame, ratio: float, gap: int, head: int = 100, least_range: float = 1.0, smooth: int | None = None, split: tuple[int, int] | None = None) -> DataFrame:
    """``threshold_groups``, also of smoothed samples, in one pass over many traces at a time; with ``split`` (wider_than, gap) broad ones are split as by ``split_broad``, parts begin and end at their top."""
    taps = st.fit_rows(smooth) if smooth else None

    def run(t: pa.Table, begin: np.ndarray) -> dict[str, np.ndarray]:
        scan, y = t.column("scan").to_numpy(), np.concatenate([k.smoothed(y, taps) if smooth else y for y in _samples(t, begin)])
        trace, top, left, right, n, area = k.groups_over(scan, y, begin, ratio, gap, head, least_range)
        if split:
            broad = np.flatnonzero(scan[right] - scan[left] > split[0])
            parts = [y[i : j + 1] for i, j in zip(left[broad].tolist(), right[broad].tolist())]
            most, least = np.array([z.max() for z in parts]), np.array([z.min() for z in parts])
            p = k.find_many(parts, 0.15 * most, 2 * split[1], 0.05 * (most - least))
            p = p.where(np.bincount(p.trace, minlength=len(parts))[p.trace] >= 2)
            whole, at = np.setdiff1d(np.arange(len(trace)), broad[p.trace]), left[broad[p.trace]] + p.place
            of = trace[broad[p.trace]]
            around = [float(np.trapezoid(y[max(begin[i], q - 8) : min(begin[i + 1], q + 9)])) for i, q in zip(of.tolist(), at.tolist())]
            trace, top, n, area = (np.concatenate([x[whole], z]) for x, z in ((trace, of), (top, at), (n, np.ones(len(at), int)), (area, np.array(around, float))))
            left, right = np.concatenate([left[whole], at]), np.concatenate([right[whole], at])
        return {"trace": trace, "scan": scan[top], "height": y[top], "left": scan[left], "right": scan[right], "n_points": n, "area": area}

    return by_trace(long.select(*BY_CHANNEL, F.col("scan").cast("long").alias("scan"), "y"), BY_CHANNEL, run, "scan long, height double, left long, right long, n_points long, area double")


def refine(peaks: DataFrame, distance: int, least_share: float) -> DataFrame:
    """Merge doublets, then drop what is low against the well's tallest.

    A peak within ``distance`` of the current one joins it; the current place moves to the taller. The fold runs over the well's
    sorted array of peaks inside Spark. Areas and points add up, the right end moves on.
    """
    item = F.struct("scan", "height", "area", "left", "right", "n_points")
    folded = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.expr("cast(array() as array<struct<scan:bigint,height:double,area:double,left:bigint,right:bigint,n_points:bigint>>)"),
        lambda acc, x: _fold(acc, x, distance),
    )
    typed = peaks.select(*BY_CHANNEL, F.col("scan").cast("long"), F.col("height").cast("double"), F.col("area").cast("double"), F.col("left").cast("long"), F.col("right").cast("long"), F.col("n_points").cast("long"))
    merged = typed.groupBy(*BY_CHANNEL).agg(folded.alias("_p")).select(*BY_CHANNEL, F.inline("_p"))
    return merged.withColumn("_top", F.max("height").over(st.whole("channel"))).where(F.col("height") >= least_share * F.col("_top")).drop("_top")


def _fold(acc: Column, x: Column, distance: int) -> Column:
    last = F.get(acc, F.size(acc) - 1)
    taller = x["height"] > last["height"]
    joined = F.struct(
        F.when(taller, x["scan"]).otherwise(last["scan"]).alias("scan"), F.greatest(x["height"], last["height"]).alias("height"),
        (last["area"] + x["area"]).alias("area"), last["left"].alias("left"), x["right"].alias("right"), (last["n_points"] + x["n_points"]).alias("n_points"),
    )
    near = (F.size(acc) > 0) & (x["scan"] - last["scan"] <= distance)
    return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))


def top_peaks(peaks: DataFrame, n: int, by: list[str] = BY_CHANNEL) -> DataFrame:
    """The n tallest; of equals the earlier scan."""
    order = Window.partitionBy(*by).orderBy(F.desc("height"), "scan")
    return peaks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def standard_display_filter(peaks: DataFrame, channel: str, n: int) -> DataFrame:
    """Only the n tallest of the standard's channel; other channels are untouched."""
    order = Window.partitionBy(*BY_CHANNEL).orderBy(F.desc("height"), "scan")
    return peaks.withColumn("_n", F.row_number().over(order)).where((F.col("channel") != channel) | (F.col("_n") <= n)).drop("_n")


def without_primer(peaks: DataFrame, gap: float = 30) -> DataFrame:
    """Drop a first peak that stands more than ``gap`` before the second."""
    w = st.scans("channel")
    lone = (F.row_number().over(w) == 1) & F.coalesce(F.lead("scan").over(w) - F.col("scan") > gap, F.lit(False))
    return peaks.withColumn("_p", lone).where(~F.col("_p")).drop("_p")


def relative_height(peaks: DataFrame, share: float) -> DataFrame:
    """Peaks of at least a share of the well's tallest."""
    return peaks.withColumn("_t", F.max("height").over(st.whole())).where(F.col("height") >= share * F.col("_t")).drop("_t")


def window_areas(long: DataFrame, half: int) -> DataFrame:
    """Trapezoid area of the samples around every scan that has ``half`` on both sides."""
    w = st.scans("channel")
    n = F.count(F.lit(1)).over(st.whole("channel"))
    inner = F.sum("y").over(w.rowsBetween(-half, half)) - (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2
    d = long.withColumns({"area": inner, "_n": n})
    return d.where((F.col("scan") >= half) & (F.col("scan") < F.col("_n") - half)).drop("_n")


#: Lengths of the stretches whose minima the walk skips by.
STRETCHES = (4, 16, 64, 256, 1024, 4096)


def half_width(long: DataFrame, peaks: DataFrame) -> DataFrame:
    """Full width at half maximum: from the nearest scans on both sides that are not above half the peak's height, or the trace's ends.

    Each scan carries the minima of the stretches of 4, 16, ... 4096 samples that end there, by nested windows over one sort. A peak's walk skips
    a whole stretch whose minimum is above its limit, so it looks at some forty samples of its trace's array and not at all of it.
    ``peaks`` stand at scans of the trace; others have no width.
    """
    w = st.scans("channel")
    d = long.select(*BY_CHANNEL, "scan", F.col("y").cast("double").alias("_m1")).withColumn("_i", F.row_number().over(w) - 1)
    shorter = 1
    for n in STRETCHES:
        d = d.withColumn(f"_m{n}", F.least(*[F.lag(f"_m{shorter}", j * shorter).over(w) if j else F.col(f"_m{shorter}") for j in range(n // shorter)]))
        shorter = n
    minima = [f"_m{n}" for n in (1, *STRETCHES)]
    at = peaks.select(*BY_CHANNEL, F.col("scan").cast("long").alias("scan"), F.col("height").cast("double").alias("height"))
    found = at.join(d.select(*BY_CHANNEL, "scan", "_i"), [*BY_CHANNEL, "scan"]).groupBy(*BY_CHANNEL).agg(F.collect_list(F.struct("_i", "scan", "height")).alias("_peaks"))
    traces = d.groupBy(*BY_CHANNEL).agg(F.array_sort(F.collect_list(F.struct("_i", F.col("scan").cast("long").alias("scan"), *minima))).alias("_t"))
    one = traces.join(found, BY_CHANNEL).withColumn("_size", F.size("_t"))
    # Stretches from the longest down: as many of the longest as the trace has, then at most three of each.
    longest = STRETCHES[-1]
    steps = F.concat(F.array_repeat(F.lit(longest), (F.col("_size") / longest).cast("int")), *[F.array_repeat(F.lit(n), 3) for n in (*STRETCHES[-2::-1], 1)])
    sample = lambda i, n: F.get("_t", i.cast("int"))[f"_m{n}"]

    def lowest(i: Column, n: Column) -> Column:
        out = sample(i, 1)
        for length in STRETCHES:
            out = F.when(n == length, sample(i, length)).otherwise(out)
        return out

    def sides(p: Column) -> Column:
        limit = p["height"] / 2
        left = F.aggregate(steps, (p["_i"] - 1).cast("long"), lambda i, n: F.when((i - n + 1 >= 0) & (lowest(i, n) > limit), i - n).otherwise(i))
        right = F.aggregate(steps, (p["_i"] + 1).cast("long"), lambda i, n: F.when((i + n <= F.col("_size")) & (lowest(i + n - 1, n) > limit), i + n).otherwise(i))
        scan = lambda i: F.get("_t", i.cast("int"))["scan"]
        return F.struct(p["scan"].alias("scan"), p["height"].alias("height"), scan(F.greatest(left, F.lit(0))).alias("left"), scan(F.least(right, F.col("_size") - 1)).alias("right"))

    out = one.select(*BY_CHANNEL, F.inline(F.transform("_peaks", sides)))
    return out.withColumn("fwhm", F.col("right") - F.col("left"))


def deconvolve(long: DataFrame, peaks: DataFrame, margin: int = 15, smooth: int | None = None) -> DataFrame:
    """Fit one Gaussian per peak to a well's region, smoothed over ``smooth`` samples if given; heights, areas and widths come from the fit, or stay if it fails (sigma null)."""
    taps = st.fit_rows(smooth) if smooth else None

    def run(key: tuple, trace: pa.Table, found: pa.Table) -> pa.Table:
        scan, y = (trace.column(c).to_numpy().astype(float) for c in ("scan", "y"))
        out = {c: found.column(c).to_numpy().astype(float) for c in ("scan", "height", "area")}
        by, order = np.argsort(out["scan"], kind="stable"), np.argsort(scan, kind="stable")
        out = {c: v[by] for c, v in out.items()} | {c: np.full(len(by), np.nan) for c in ("sigma", "fwhm")}
        if len(by) and len(order):
            scan, y = scan[order], k.smoothed(y[order], taps) if smooth else y[order]
            inside = (scan >= out["scan"][0] - margin) & (scan <= out["scan"][-1] + margin)
            fit = k.fit_gaussians(scan[inside], y[inside], np.stack([out["height"], out["scan"], np.full(len(by), 3.0)], axis=1))
            if fit is not None:
                area = fit[:, 0] * fit[:, 2] * np.sqrt(2 * np.pi)
                out = {"scan": fit[:, 1], "height": fit[:, 0], "area": area, "sigma": fit[:, 2], "fwhm": 2.355 * fit[:, 2]}
        return pa.table({c: found.column(c) for c in BY_CHANNEL} | {c: pa.array(v, from_pandas=True) for c, v in out.items()})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*BY_CHANNEL).schema)
    left, right = long.select(*BY_CHANNEL, "scan", "y"), peaks.select(*BY_CHANNEL, F.col("scan").cast("double"), "height", "area")
    return by_group(left, right, BY_CHANNEL, run, f"{keys}, scan double, height double, area double, sigma double, fwhm double", arrow=True)


def split_broad(long: DataFrame, groups: DataFrame, wider_than: int = 50, gap: int = 15) -> DataFrame:
    """Groups wider than a limit are searched for sub-peaks; each of two or more stands for itself with its +-8 trapezoid area."""

    def run(key: tuple, trace: pa.Table, found: pa.Table) -> pa.Table:
        trace, out = trace.sort_by("scan"), []
        scan, y = trace.column("scan").to_numpy(), trace.column("y").to_numpy().astype(float)
        for g in found.sort_by("scan").to_pylist():
            part = np.flatnonzero((scan >= g["left"]) & (scan <= g["right"]))
            sub = np.zeros(0, int)
            if g["right"] - g["left"] > wider_than and len(part):
                z = y[part]
                sub = part[k.find_peaks(z, 0.15 * z.max(), 2 * gap, 0.05 * (z.max() - z.min()))]
            if len(sub) < 2:
                out.append((g["scan"], g["height"], g["area"], 1))
            else:
                out += [(scan[q], y[q], float(np.trapezoid(y[max(0, q - 8) : q + 9])), len(sub)) for q in sub]
        of = found.select(BY_CHANNEL).take(pa.array([0] * len(out), pa.int64()))
        named = zip(("scan", "height", "area", "n_parts"), zip(*out) if out else [()] * 4, (pa.int64(), pa.float64(), pa.float64(), pa.int64()))
        return pa.table({c: of.column(c) for c in BY_CHANNEL} | {c: pa.array(list(v), kind) for c, v, kind in named})

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.select(*BY_CHANNEL).schema)
    right = groups.select(*BY_CHANNEL, "scan", "height", "area", "left", "right")
    return by_group(long.select(*BY_CHANNEL, "scan", "y"), right, BY_CHANNEL, run, f"{keys}, scan long, height double, area double, n_parts long", arrow=True)


def with_edits(peaks: DataFrame, edits: DataFrame) -> DataFrame:
    """Peaks less the deleted scans of their well, plus the added (scan, channel) that are not there yet.

    ``edits`` is the folded log: (plate, well, op 'delete' or 'add', scan, channel).
    """
    gone = edits.where("op = 'delete'").select(*WELL, "scan").distinct()
    kept = peaks.join(gone, [*WELL, "scan"], "left_anti").withColumn("manual", F.lit(False))
    added = edits.where("op = 'add'").select(*WELL, "channel", "scan").distinct()
    fresh = added.join(kept.select(*WELL, "scan").distinct(), [*WELL, "scan"], "left_anti")
    return kept.select(*BY_CHANNEL, "scan", "manual").unionByName(fresh.select(*BY_CHANNEL, "scan", F.lit(True).alias("manual")))


def cut_short_wells(trace: DataFrame, least: int = 50) -> DataFrame:
    """Only wells of at least so many scans."""
    return trace.withColumn("_n", F.count(F.lit(1)).over(st.whole())).where(F.col("_n") >= least).drop("_n")


def picked(clicks: DataFrame, peaks: DataFrame, within: float = 10) -> DataFrame:
    """The peak nearest to each clicked place (plate, well, at) and nearer than ``within``; of equals the lower one."""
    found = range_join(clicks, peaks, WELL, "scan", F.col("at") - within, F.col("at") + within, max(1, int(2 * within))).where(F.abs(F.col("scan") - F.col("at")) < within)
    order = Window.partitionBy(*WELL, "at").orderBy(F.abs(F.col("scan") - F.col("at")), "scan", "channel")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def channel_of_greatest(trace: DataFrame) -> DataFrame:
    """Each scan's channel of the greatest sample, the first of equals."""
    return trace.withColumn("channel", F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), st.argmax(CHANNELS) + 1))


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"np", "pd", "pa", "k", "st", "signal"}]
