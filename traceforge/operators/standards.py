"""The internal standard: reference search, matching, amplification test and features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stencils as st
from ..schema import WELL
from .joins import combinations4, nearest, range_join


def quality(trace: DataFrame, channel: str = "c3") -> DataFrame:
    """Mean of the standard's channel over each scan and two on both sides."""
    return trace.withColumn("quality", F.avg(channel).over(st.scans().rowsBetween(-2, 2)))


def consistent_candidates(peaks: DataFrame, first_scan: int = 500, most: int = 40, within: float = 50, share: float = 0.5, spread: float = 10) -> DataFrame:
    """Peaks of a plate's first well that most wells have nearby: plate, scan, n_wells, std_scan, score.

    The first well in order is the template; its ``most`` tallest peaks after ``first_scan`` are candidates. Each well gives its nearest
    peak; a candidate needs max(4, share of wells) of them and a population deviation of at most ``spread``.
    ``peaks``: plate, well, scan, height, quality.
    """
    kind = {f.name: f.dataType.simpleString() for f in peaks.select("plate", "scan").schema}
    # One row a well, dealt once and read twice: no task holds a plate's peaks.
    wells = peaks.groupBy(*WELL).agg(F.collect_list(F.struct("scan", "height", "quality")).alias("p")).repartition(*WELL)
    late = lambda p: F.filter(p, lambda x: x["scan"] >= first_scan)
    ranked = lambda p: F.array_sort(F.transform(late(p), lambda x: F.struct((-x["height"]).alias("h"), x["scan"].alias("ref"), x["quality"].alias("ref_quality"))))
    plates = wells.groupBy("plate").agg(F.min_by("p", "well").alias("p"), F.count(F.lit(1)).alias("_n")).select("plate", "_n", F.slice(ranked("p"), 1, most).alias("refs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [_nearest_places(np.sort(places), refs, within) for places, refs in ((x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(b.column("places"), b.column("refs")))]
            of = pa.array(np.repeat(np.arange(b.num_rows), [len(at) for at, _ in near]))
            at, scan = (np.concatenate([x[i] for x in near]) if near else np.zeros(0, int) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("plate").take(of), pa.array(at), pa.array(scan)], names=["plate", "ref", "scan"])

    both = wells.join(plates, "plate").select("plate", "well", F.transform("p", lambda x: x["scan"]).alias("places"), F.transform("refs", lambda x: x["ref"]).alias("refs"))
    found = both.mapInArrow(run, f"plate {kind['plate']}, ref {kind['scan']}, scan {kind['scan']}")
    by_ref = found.groupBy("plate", "ref").agg(F.count(F.lit(1)).alias("n_wells"), F.stddev_pop("scan").alias("std_scan"))
    by_ref = by_ref.join(plates.select("plate", "_n", F.inline("refs")).drop("h"), ["plate", "ref"])
    good = by_ref.where((F.col("n_wells") >= F.greatest(F.lit(4), F.floor(F.col("_n") * share))) & (F.col("std_scan") <= spread) & (F.col("ref_quality") > 0))
    return good.select("plate", F.col("ref").alias("scan"), "n_wells", "std_scan", (F.col("ref_quality") / F.greatest("std_scan", F.lit(0.1))).alias("score"))


def _nearest_places(places: np.ndarray, refs: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """The references that have a place (places ascend) within reach, and the nearest of each, of equals the lower one."""
    i = np.searchsorted(places, refs)
    below, above = places[np.maximum(i - 1, 0)], places[np.minimum(i, len(places) - 1)]
    best = np.where((i > 0) & ((i == len(places)) | (refs - below <= above - refs)), below, above)
    near = np.abs(best - refs) <= within
    return refs[near], best[near]


def best_four(candidates: DataFrame, group: list[str], place: str = "scan", score: str = "score", spacing: float = 10, span: float = 150) -> DataFrame:
    """The best set of four: sum of scores, times the span over 3000, over one and the spacings' relative deviation; of equals the first in order."""
    sets = combinations4(candidates, group, place, score, spacing, span)
    gaps = [F.col(f"p{i + 1}") - F.col(f"p{i}") for i in (1, 2, 3)]
    mean = (gaps[0] + gaps[1] + gaps[2]) / 3
    deviation = F.sqrt(((gaps[0] - mean) ** 2 + (gaps[1] - mean) ** 2 + (gaps[2] - mean) ** 2) / 3)
    total = (F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")) * ((F.col("p4") - F.col("p1")) / 3000.0) / (1 + deviation / F.greatest(mean, F.lit(1.0)))
    order = Window.partitionBy(*group).orderBy(F.desc("total"), "p1", "p2", "p3", "p4")
    return sets.withColumn("total", F.round(total, 6)).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def farthest_spread(candidates: DataFrame, n: int = 4, least: float = 100) -> DataFrame:
    """Reference places of a plate where no set of four fits: the best-scored candidate, then again and again the one of the greatest
    distance to the nearest chosen one times its score, while that is ``least`` or more.

    ``candidates``: plate, scan, score, at most some dozens a plate. Plates that reach fewer than max(2, n - 1) have none. Of equals the earlier candidate by
    score, then scan. Places are rounded half to even.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "scan"], ascending=[False, True], kind="stable")
        place, score = pdf["scan"].to_numpy(float), pdf["score"].to_numpy(float)
        chosen, free = [0], list(range(1, len(pdf)))
        while len(chosen) < n and free:
            value = [np.abs(place[i] - place[chosen]).min() * score[i] for i in free]
            j = int(np.argmax(value))
            if value[j] < least:
                break
            chosen.append(free.pop(j))
        picked = sorted(chosen, key=lambda i: place[i]) if len(chosen) >= max(2, n - 1) else []
        out = pdf.iloc[picked]
        return out.assign(ref_idx=np.arange(1, len(picked) + 1), ref_scan=np.rint(out["scan"].to_numpy(float)).astype(int))[["plate", "ref_idx", "ref_scan"]]

    kind = candidates.schema["plate"].dataType.simpleString()
    return candidates.select("plate", "scan", "score").groupBy("plate").applyInPandas(run, f"plate {kind}, ref_idx long, ref_scan long")


def plate_references(candidates: DataFrame, manual: DataFrame, n: int = 4) -> DataFrame:
    """References of each plate (plate, ref_idx, ref_scan, how): the best four of its consistent candidates, else the farthest spread ones, else those set by hand.

    Plates with fewer than ``n`` candidates have none of their own. ``manual``: plate, ref_idx, ref_scan.
    """
    c = candidates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("plate"))).where(F.col("_n") >= n).drop("_n")
    four = best_four(c, ["plate"]).select("plate", F.posexplode(F.array("p1", "p2", "p3", "p4")).alias("i", "p"))
    four = four.select("plate", (F.col("i") + 1).cast("long").alias("ref_idx"), F.col("p").cast("long").alias("ref_scan"), F.lit("pattern").alias("how"))
    spread = farthest_spread(c.join(four.select("plate").distinct(), "plate", "left_anti"), n).withColumn("how", F.lit("spread"))
    own = four.unionByName(spread)
    rest = manual.join(own.select("plate").distinct(), "plate", "left_anti")
    return own.unionByName(rest.select("plate", F.col("ref_idx").cast("long").alias("ref_idx"), F.col("ref_scan").cast("long").alias("ref_scan"), F.lit("manual").alias("how")))


def greedy_references(references: DataFrame, peaks: DataFrame, within: int = 150) -> DataFrame:
    """Each reference in order takes the nearest peak of a well that no earlier one took and that is no farther than ``within``; of equals the lower one.

    ``references``: plate, ref_idx, ref_scan; ``peaks``: plate, well, scan, of any number of sources. Folded over the references inside a well's row.
    """
    wells = peaks.groupBy(*WELL).agg(F.collect_set(F.col("scan").cast("long")).alias("p"))
    refs = references.groupBy("plate").agg(F.array_sort(F.collect_list(F.struct(F.col("ref_idx").cast("long").alias("ref_idx"), F.col("ref_scan").cast("long").alias("ref_scan")))).alias("r"))
    empty = F.expr("cast(array() as array<struct<ref_idx:bigint,ref_scan:bigint,scan:bigint>>)")

    def step(taken: Column, ref: Column) -> Column:
        far = lambda x: F.abs(x - ref["ref_scan"])
        free = F.filter("p", lambda x: (far(x) <= within) & ~F.array_contains(F.transform(taken, lambda t: t["scan"]), x))
        best = F.array_min(F.transform(free, lambda x: F.struct(far(x).alias("d"), x.alias("s"))))
        return F.when(best.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(ref["ref_idx"].alias("ref_idx"), ref["ref_scan"].alias("ref_scan"), best["s"].alias("scan")))))

    return wells.join(refs, "plate").select(*WELL, F.inline(F.aggregate("r", empty, step)))


def standard_examples(features: DataFrame, candidates: DataFrame, marked: DataFrame, n: int = 4) -> DataFrame:
    """Rows that a classifier of standard peaks learns from: in wells with exactly ``n`` marked peaks these (label 1), and the first 2 n other candidates by scan (label 0).

    ``features``: plate, well, scan and columns; ``candidates`` and ``marked``: plate, well, scan.
    """
    m = marked.select(*WELL, "scan").distinct()
    usable = m.groupBy(*WELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select(*WELL)
    good = m.join(usable, WELL, "left_semi").withColumn("label", F.lit(1.0))
    order = Window.partitionBy(*WELL).orderBy("scan")
    others = candidates.select(*WELL, "scan").distinct().join(usable, WELL, "left_semi").join(m, [*WELL, "scan"], "left_anti")
    bad = others.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= 2 * n).select(*WELL, "scan", F.lit(0.0).alias("label"))
    return features.join(good.unionByName(bad), [*WELL, "scan"])


def best_scored(scored: DataFrame, n: int = 4) -> DataFrame:
    """The ``n`` best-scored candidates of each well (plate, well, scan, score), of equals the lower scan, numbered by scan."""
    order = Window.partitionBy(*WELL).orderBy(F.desc("score"), "scan")
    top = scored.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    return top.select(*WELL, "scan", "score", F.row_number().over(st.scans()).cast("long").alias("idx"))


def match_references(references: DataFrame, peaks: DataFrame, within: float = 50, missing: int = 1) -> DataFrame:
    """Each reference's nearest peak in every well; wells that match at least max(2, references - missing) stay. ``references``: plate, ref_idx, ref_scan."""
    found = nearest(references, peaks, ["plate"], "ref_scan", "scan", within, ["plate", "well", "ref_idx"])
    total = references.groupBy("plate").agg(F.count(F.lit(1)).alias("_refs"))
    n = F.count(F.lit(1)).over(st.whole())
    return found.join(total, "plate").withColumn("_n", n).where(F.col("_n") >= F.greatest(F.lit(2), F.col("_refs") - missing)).drop("_n", "_refs")


def greatest_near_references(trace: DataFrame, references: DataFrame, channel: str = "c3", before: int = 150, after: int = 150, floor: float = 100, factor: float = 5) -> DataFrame:
    """The greatest sample around each reference if it is high enough; no reference and no scan is used twice, nearer pairs first."""
    noise = F.stddev_pop(F.when(F.col("scan") < 200, F.col(channel))).over(st.whole())
    d = trace.withColumn("_noise", noise).select(*WELL, "scan", F.col(channel).alias("y"), "_noise")
    found = range_join(references, d, ["plate"], "scan", F.col("ref_scan") - before, F.col("ref_scan") + after - 1, before + after)
    top = found.groupBy(*WELL, "ref_idx", "ref_scan").agg(F.max(F.struct("y", (-F.col("scan")).alias("s"))).alias("t"), F.max("_noise").alias("_noise"))
    high = top.where(F.col("t.y") >= F.greatest(F.lit(floor), factor * F.col("_noise"))).select(*WELL, "ref_idx", "ref_scan", (-F.col("t.s")).alias("scan"), F.col("t.y").alias("height"))
    # One candidate per reference: exclusivity only has to part references that chose the same scan.
    order = Window.partitionBy(*WELL, "scan").orderBy(F.abs(F.col("scan") - F.col("ref_scan")), "ref_idx")
    return high.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def amplified(wells_refs: DataFrame, peaks: DataFrame, far: int = 30, near: int = 1) -> DataFrame:
    """Wells with a product peak shortly before some reference. ``wells_refs``: plate, well, ref_scan."""
    hit = range_join(wells_refs, peaks.select(*WELL, "scan"), WELL, "scan", F.greatest(F.lit(0), F.col("ref_scan") - far), F.greatest(F.lit(0), F.col("ref_scan") - near), far)
    return hit.select(*WELL).distinct()


def peak_features(trace: DataFrame, noise: DataFrame, half: int = 8) -> DataFrame:
    """Features of every scan as a standard's peak: over noise, against the product channel, prominence, local deviation, and nine offsets."""
    w = st.scans()
    frame = w.rowsBetween(-half, half)
    # One frame for all scans of a well: a frame that ends with the well but begins at each scan is gone through again for every one.
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("c3").over(every), F.last("c3").over(every)
    edge = lambda k: F.coalesce(st.at(F.col("c3"), k, w), first if k < 0 else last)
    d = trace.join(noise, WELL)
    over = F.col("noise") + 1
    found = {
        "snr": F.col("c3") / over, "ratio": F.col("c3") / (F.col("c2") + 1), "prominence": (F.col("c3") - F.min("c3").over(frame)) / over,
        "local_std": F.stddev_pop("c3").over(frame) / over, "to_product": F.col("c3") / (F.max("c2").over(frame) + 1),
    } | {f"at_{k + 4}": edge(k) / over for k in range(-4, 5)}
    return d.select(*WELL, "scan", *[v.alias(n) for n, v in found.items()])


def spacing(peaks: DataFrame) -> DataFrame:
    """The plate's median distance between neighbouring standard peaks of a well."""
    gap = F.col("scan") - F.lag("scan").over(st.scans())
    return peaks.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("plate").agg(F.percentile("gap", F.lit(0.5)).alias("spacing"), F.count(F.lit(1)).alias("n_gaps"))


def area_ratio(peaks: DataFrame, channel: str, nth: int) -> DataFrame:
    """Area of the standard channel's nth peak, and of all peaks over it (areas as whole numbers; 0 if there is none)."""
    whole = peaks.withColumn("a", F.bround("area", 0))
    order = Window.partitionBy("plate").orderBy(F.when(F.col("channel") == channel, 0).otherwise(1), "well", "scan")
    nth_area = F.max(F.when((F.col("channel") == channel) & (F.col("_k") == nth), F.col("a")))
    return whole.withColumn("_k", F.row_number().over(order)).groupBy("plate").agg(nth_area.alias("standard_area"), F.sum("a").alias("total_area")).withColumn(
        "ratio", F.coalesce(F.try_divide("total_area", "standard_area"), F.lit(0.0))
    )
