"""Base calls from peaks: by chemistry, by unmixed dyes with mobility search, by a scorer, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as k
from ..functions import stencils as st
from ..schema import CHANNELS, CHEMISTRY_BASES, MOBILITY_SEARCH, NOISE_SCANS, SPECTRAL_MATRIX, WELL
from .peaks import detect_for_bases

DYES = ["d1", "d2", "d3", "d4"]


def check_matrix(matrix) -> None:
    """A spectral matrix needs diagonals of at least 0.7 and no other entry of a row over half its diagonal."""
    m = np.array(matrix, float)
    off = m - np.diag(np.diag(m))
    if m.shape != (4, 4) or (np.diag(m) < 0.7).any() or (off.max(axis=1) > 0.5 * np.diag(m)).any():
        raise ValueError("spectral matrix: diagonal under 0.7, or an entry over half its row's diagonal")


def chemistry_calls(peaks: DataFrame, trace: DataFrame, chemistry: str, least: int = 10) -> DataFrame:
    """A base per peak by its channel; quality is the channel's share of the raw total in percent, under 10 it is 0, under ``least`` the base is N."""
    bases = CHEMISTRY_BASES[chemistry]
    d = peaks.select(*WELL, "channel", "scan").join(trace.select(*WELL, "scan", *CHANNELS), [*WELL, "scan"])
    pick = lambda values: F.element_at(F.create_map(*[x for c, v in zip(CHANNELS, values) for x in (F.lit(c), v)]), F.col("channel"))
    total = F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4")
    share = F.when(total > 0, pick([F.col(c) for c in CHANNELS]) / total).otherwise(0.0)
    raw = F.bround(F.least(100 * share, F.lit(100.0))).cast("int")
    d = d.withColumn("quality", F.when(raw < 10, 0).otherwise(raw))
    return d.select(*WELL, "scan", "channel", F.when(F.col("quality") < least, "N").otherwise(pick([F.lit(b) for b in bases])).alias("base"), "quality")


def mobility_search(trace: DataFrame, peaks: DataFrame, dyes: list[str] = DYES, half: int = 2) -> DataFrame:
    """The channel and offset that explain a peak best: at each allowed offset the dye's sum over +-half against all dyes'.

    Sums are framed once per scan, so a try is one equality join. Of equal shares the channel and offset tried first win; none positive: channel of the greatest sum at offset 0.
    """
    w, n = st.scans(), F.count(F.lit(1)).over(st.whole())
    sums = trace.select(*WELL, "scan", n.alias("_n"), *[F.sum(d).over(w.rowsBetween(-half, half)).alias(f"sum_{d}") for d in dyes])
    size = sums.groupBy(*WELL).agg(F.max("_n").alias("_n"))
    tries = [(c, o, i) for i, (c, o) in enumerate((c, o) for c, os in MOBILITY_SEARCH.items() for o in os)]
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("dye"), F.lit(o).alias("offset"), F.lit(i).alias("nth")) for c, o, i in tries]))
    tried = peaks.select(*WELL, F.col("scan").alias("peak"), t.alias("t")).join(size, WELL).select(*WELL, "peak", "t.*", F.greatest(F.lit(half), F.least(F.col("peak") + F.col("t.offset"), F.col("_n") - 1 - half)).cast("long").alias("scan"))
    total = F.expr("+".join(f"sum_{d}" for d in dyes))
    own = F.element_at(F.array(*[F.col(f"sum_{d}") for d in dyes]), F.col("dye") + 1)
    scored = tried.join(sums, [*WELL, "scan"]).withColumn("share", F.when(total > 0, own / total).otherwise(0.0))
    order = Window.partitionBy(*WELL, "peak").orderBy(F.desc("share"), "nth")
    return scored.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*WELL, F.col("peak").alias("scan"), "dye", "offset", "share")


def dye_calls(trace: DataFrame, peaks: DataFrame, noise: DataFrame, bases: str = "TGCA", least: int = 10, dyes: list[str] = DYES) -> DataFrame:
    """Calls from unmixed dyes: the greatest dye at the peak; quality from its share and its height over noise.

    ``noise``: plate, well, noise_d1..noise_d4. quality = round(0.5 * 100 share + 0.3 * min(5 snr, 100) + 0.2 * min(10 snr, 100)), at most 100.
    """
    d = peaks.select(*WELL, "scan").join(trace.select(*WELL, "scan", *dyes), [*WELL, "scan"]).join(noise, WELL)
    d = d.withColumn("dye", st.argmax(dyes))
    own = F.greatest(*dyes)
    total = F.expr("+".join(dyes))
    own_noise = F.element_at(F.array(*[F.col(f"noise_{x}") for x in dyes]), F.col("dye") + 1)
    snr = own / own_noise
    share = F.when(total > 0, own / total).otherwise(0.0)
    quality = F.least(F.bround(50 * share + 0.3 * F.least(5 * snr, F.lit(100.0)) + 0.2 * F.least(10 * snr, F.lit(100.0))), F.lit(100.0)).cast("int")
    d = d.withColumn("quality", quality)
    base = F.element_at(F.array(*[F.lit(b) for b in bases]), F.col("dye") + 1)
    return d.select(*WELL, "scan", "dye", F.when(F.col("quality") < least, "N").otherwise(base).alias("base"), "quality")


def gap_check(calls: DataFrame, least: int = 10) -> DataFrame:
    """Halve the quality left of gaps over three times the well's median gap (and over 2); below ``least`` the base is N. Needs three peaks and a median of 1."""
    gap = F.lead("scan").over(st.scans()) - F.col("scan")
    d = calls.withColumn("gap", gap)
    d = d.withColumn("median_gap", F.percentile("gap", F.lit(0.5)).over(st.whole())).withColumn("_n", F.count(F.lit(1)).over(st.whole()))
    wide = F.coalesce((F.col("_n") >= 3) & (F.col("median_gap") >= 1) & (F.col("gap") > 3 * F.col("median_gap")) & (F.col("gap") > 2), F.lit(False))
    d = d.withColumn("wide_gap", wide).withColumn("quality", F.when(wide, F.floor(F.col("quality") / 2)).otherwise(F.col("quality")).cast("int"))
    return d.withColumn("base", F.when(F.col("quality") < least, "N").otherwise(F.col("base"))).drop("_n")


def even_spacing(calls: DataFrame) -> DataFrame:
    """Drop calls nearer to the last kept one than half the median gap (at least 2); a single call stays. Folded over the well's sorted array."""
    gap = F.col("scan") - F.lag("scan").over(st.scans())
    d = calls.withColumn("_g", gap).withColumn("_need", F.greatest(F.lit(2), F.floor(F.floor(F.percentile("_g", F.lit(0.5)).over(st.whole())) / 2)).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("scan").cast("long").alias("scan"), "base", F.col("quality").cast("int").alias("quality"))))
    empty = F.expr("cast(array() as array<struct<scan:bigint,base:string,quality:int>>)")
    need = F.max(F.coalesce("_need", F.lit(2)))
    grouped = d.groupBy(*WELL).agg(rows.alias("r"), need.alias("need"))
    kept = F.aggregate("r", empty, lambda acc, x: F.when((F.size(acc) == 0) | (x["scan"] - F.get(acc, F.size(acc) - 1)["scan"] >= F.col("need")), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.withColumn("k", kept).select(*WELL, F.inline("k"))


def call_bases(trace: DataFrame, chemistry: str, matrix=SPECTRAL_MATRIX, detect: Callable[[DataFrame], DataFrame] = detect_for_bases) -> DataFrame:
    """Calls of a trace by the name of a chemistry or caller: plate, well, position, base, quality.

    A chemistry of ``CHEMISTRY_BASES`` calls each detected peak by its channel. "Cimarron 3.12" and its variants unmix the trace with ``matrix``, move
    peaks by the mobility search and check gaps: "... Aligned" rounds the places of good calls, "... Even Spacing" thins the calls. Any other name is refused.
    """
    if chemistry in CHEMISTRY_BASES and chemistry != "Cimarron":
        return chemistry_calls(detect(trace), trace, chemistry).select(*WELL, F.col("scan").cast("double").alias("position"), "base", F.col("quality").cast("long").alias("quality"))
    if not chemistry.startswith("Cimarron"):
        raise ValueError(f"no caller for {chemistry}")
    check_matrix(matrix)
    dyed = trace.withColumns(dict(zip(DYES, st.unmixed(CHANNELS, matrix))))
    noise = dyed.groupBy(*WELL).agg(*[(F.stddev_pop(F.when(F.col("scan") < NOISE_SCANS, F.col(x))) + 1e-8).alias(f"noise_{x}") for x in DYES])
    found = detect(trace).select(*WELL, "scan").distinct()
    moved = mobility_search(dyed, found).select(*WELL, (F.col("scan") + F.col("offset")).alias("scan")).distinct()
    calls = gap_check(dye_calls(dyed, moved, noise)).select(*WELL, "scan", "base", "quality")
    if chemistry.endswith("Even Spacing"):
        calls = even_spacing(calls)
    calls = calls.select(*WELL, F.col("scan").cast("double").alias("position"), "base", F.col("quality").cast("long").alias("quality"))
    return rounded_positions(calls) if chemistry.endswith("Aligned") else calls


def rounded_positions(calls: DataFrame, least: int = 30) -> DataFrame:
    """Whole positions (halves to even) for called bases of enough quality."""
    return calls.withColumn("position", F.when((F.col("base") != "N") & (F.col("quality") >= least), F.bround("position")).otherwise(F.col("position")))


Scorer = Callable[[np.ndarray], np.ndarray]


def scored_calls(windows: DataFrame, scorer: Scorer, classes: str = "ACGT", least: int = 10, channels: list[str] = CHANNELS) -> DataFrame:
    """Calls of a model at windows (plate, well, position, x_c1..x_c4): ``scorer`` maps (n, places, channels) z-scores to probabilities.

    quality = round(100 p); under ``least`` the base is N and the quality ``least``. Arrow batches, no shuffle; rows keep their scan order key.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.select(*WELL, "position").schema)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.stack(pdf[f"x_{c}"].to_list()) for c in channels], axis=2)
            x = (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + 1e-8)
            p = scorer(x)
            best, top = p.argmax(axis=1), p.max(axis=1)
            q = np.rint(100 * top).astype(int)
            out = pdf[[*WELL, "position"]].copy()
            out["base"] = [classes[b] if s >= least and b < len(classes) else "N" for b, s in zip(best, q)]
            out["quality"], out["probability"] = np.maximum(q, least), top
            yield out

    return windows.select(*WELL, "position", *[f"x_{c}" for c in channels]).mapInPandas(run, f"{keys}, base string, quality long, probability double")


def scan_calls(classified: DataFrame, least: float = 0.8, background: int = 4) -> DataFrame:
    """Calls from a class and confidence at every scan: one per run, at its most confident scan, the search resuming three scans on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("scan")
        return pdf.iloc[k.decode_runs(pdf["cls"].to_numpy(), pdf["conf"].to_numpy(), least, background)]

    d = classified.select(*WELL, "scan", "cls", "conf")
    return d.groupBy(*WELL).applyInPandas(run, d.schema)


def run_islands(classified: DataFrame, least: float, background: int = 4) -> DataFrame:
    """Maximal runs of one class of enough confidence on neighbouring scans, each with its most confident scan (the first of equals)."""
    d = classified.where((F.col("cls") < background) & (F.col("conf") >= least))
    w = st.scans()
    new = F.coalesce((F.col("cls") != F.lag("cls").over(w)) | (F.col("scan") != F.lag("scan").over(w) + 1), F.lit(True))
    d = d.withColumn("run", F.sum(new.cast("long")).over(w))
    top = F.max(F.struct("conf", (-F.col("scan")).alias("s")))
    return d.groupBy(*WELL, "run", "cls").agg(F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), top.alias("t")).select(*WELL, "cls", "first_scan", "last_scan", (-F.col("t.s")).alias("scan"), F.col("t.conf").alias("conf"))


def optimal_threshold(curve: DataFrame, target: float = 0.98, by: list[str] | None = None) -> DataFrame:
    """The lowest threshold that is accurate enough and covers anything; 0.95 if none is."""
    good = F.min(F.when((F.col("accuracy") >= target) & (F.col("coverage") > 0), F.col("threshold")))
    return curve.groupBy(*(by or [])).agg(F.coalesce(good, F.lit(0.95)).alias("threshold"))


def sequence_lines(calls: DataFrame, width: int = 60) -> DataFrame:
    """Numbered lines of a well's calls: bases, and one digit of quality each."""
    d = calls.withColumn("_i", F.row_number().over(st.scans()) - 1).withColumn("line", F.floor(F.col("_i") / width))
    item = F.struct("_i", "base", F.least(F.floor(F.col("quality") / 10), F.lit(9)).cast("string").alias("q"))
    joined = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x[f]), "")
    return d.groupBy(*WELL, "line").agg(joined("base").alias("bases"), joined("q").alias("digits")).select(*WELL, "line", F.format_string("%6d  %s", F.col("line") * width + 1, F.col("bases")).alias("text"), "digits")


def quality_glyph(q: Column) -> Column:
    """``*`` from 60, ``:`` from 20, else a point."""
    return F.when(q >= 60, "*").when(q >= 20, ":").otherwise(".")


def summary(calls: DataFrame) -> DataFrame:
    """Calls, Ns, the rate of Ns in percent, and the mean quality cut to a whole number, by well."""
    return calls.groupBy(*WELL).agg(
        F.count(F.lit(1)).alias("total_calls"), F.count_if(F.col("base") == "N").alias("n_count"), F.floor(F.avg("quality")).cast("long").alias("avg_quality"),
        F.round(100 * F.avg((F.col("base") == "N").cast("double")), 1).alias("n_rate"),
    )


def caller_name(caller: Column, names: dict[str, str]) -> Column:
    """Readable name of a caller: its exact key, else that of the longest key that is part of it, else itself."""
    out = F.when(F.lit(False), caller)
    for key in names:
        out = out.when(caller == key, names[key])
    for key in sorted(names, key=lambda k: (-len(k), k)):
        out = out.when(F.contains(caller, F.lit(key)), names[key])
    return out.otherwise(caller)
