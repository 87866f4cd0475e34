"""Training windows from labelled calls, their match to detected peaks, and checks of what is learned from them.

Calls are (plate, well, position, base, quality) rows; windows carry an array per channel, a label (A 0, C 1, G 2, T 3, else 4) and
the call's quality. Everything is joins and aggregates by well; nothing passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BASE_LABELS, CHANNELS, WELL
from . import basecall as bc
from . import signal as sg
from .joins import nearest


def label_of(base: Column) -> Column:
    """A base's label; what is no known base counts as N."""
    known = F.create_map(*[F.lit(x) for kv in BASE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, base), F.lit(BASE_LABELS["N"])).cast("int")


def good_calls(calls: DataFrame, least: float = 10) -> DataFrame:
    """Calls of A, C, G or T, in either case, of at least some quality."""
    return calls.where((F.col("quality") >= least) & F.upper("base").isin("A", "C", "G", "T"))


def training_windows(trace: DataFrame, calls: DataFrame, radius: int = 15, channels: list[str] = CHANNELS) -> DataFrame:
    """A window around each call's position (cut to a whole scan) that lies inside the trace; calls at one position have a window each."""
    keys = [c for c in calls.columns if c != "position"]
    at = calls.select(*keys, F.col("position").cast("long").alias("position"), label_of(F.col("base")).alias("label"))
    return sg.windows(trace, at, radius, channels)


def matched_calls(calls: DataFrame, peaks: DataFrame, within: int = 5) -> DataFrame:
    """Calls moved to the nearest detected peak of any channel no farther than ``within`` (of equals the lower one); others keep their place.

    ``matched`` and ``offset`` (peak less call) tell which. Calls of wells without any peak have no ``matched`` (null).
    """
    c = calls.withColumn("called_at", F.col("position").cast("long"))
    places = c.select(*WELL, "called_at").distinct()
    near = nearest(places, peaks.select(*WELL, "scan").distinct(), WELL, "called_at", "scan", within, [*WELL, "called_at"]).select(*WELL, "called_at", F.col("scan").alias("peak"))
    wells = peaks.select(*WELL).distinct().withColumn("any_peak", F.lit(True))
    d = c.join(near, [*WELL, "called_at"], "left").join(wells, WELL, "left")
    d = d.withColumn("matched", F.when(F.col("any_peak"), F.col("peak").isNotNull())).withColumn("offset", F.col("peak") - F.col("called_at"))
    return d.withColumn("position", F.coalesce("peak", "called_at")).drop("peak", "any_peak")


def matched_windows(trace: DataFrame, calls: DataFrame, peaks: DataFrame, radius: int = 15, within: int = 5, channels: list[str] = CHANNELS) -> DataFrame:
    """Windows around detector peaks near the calls, so that training and use see the same places; wells without peaks give none."""
    return training_windows(trace, moved_calls(calls, peaks, within), radius, channels)


def moved_calls(calls: DataFrame, peaks: DataFrame, within: int = 5) -> DataFrame:
    """Calls at the places of ``matched_calls``, without those of wells that have no peaks."""
    return matched_calls(calls, peaks, within).where("matched IS NOT NULL").drop("matched", "offset", "called_at")


def named_variants(calls: dict[str, DataFrame]) -> DataFrame:
    """The calls of some variants as one frame, so that windows of all are cut in one pass: ``variant`` is each one's name."""
    first, *rest = [d.withColumn("variant", F.lit(name)).withColumn("position", F.col("position").cast("double")) for name, d in calls.items()]
    return reduce(DataFrame.unionByName, rest, first)


def match_stats(matched: DataFrame, by: list[str] = WELL) -> DataFrame:
    """Matched and unmatched calls, and mean and population deviation of the matched offsets (0 without any)."""
    return matched.groupBy(*by).agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.coalesce("matched", F.lit(False))).alias("unmatched"),
        F.coalesce(F.avg("offset"), F.lit(0.0)).alias("avg_offset"), F.coalesce(F.stddev_pop("offset"), F.lit(0.0)).alias("std_offset"),
    )


def extraction_counts(windows: DataFrame) -> DataFrame:
    """Windows by label for each variant, and for all of them together (variant null): two grouping sets of one pass."""
    return windows.groupingSets([["variant", "label"], ["label"]], "variant", "label").agg(F.count(F.lit(1)).alias("n"))


def shift_accuracy(windows: DataFrame, scorer: bc.Scorer, shifts: tuple[int, ...] = (-4, -2, 2, 4), channels: list[str] = CHANNELS) -> DataFrame:
    """Accuracy of a scorer on windows moved by some scans, zeros moving in: one row per shift, all of one pass over the windows."""
    moved = F.explode(F.array(*[F.struct(F.lit(k).alias("shift"), *[sg.shifted(F.col(f"x_{c}"), k).alias(f"x_{c}") for c in channels]) for k in shifts]))
    d = windows.select(*WELL, F.struct("position", "label").alias("of"), moved.alias("m")).select(*WELL, F.struct("of.label", "m.shift").alias("position"), *[F.col(f"m.x_{c}") for c in channels])
    called = bc.scored_calls(d, scorer, least=0, channels=channels)
    right = label_of(F.col("base")) == F.col("position.label")
    return called.groupBy(F.col("position.shift").alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def discriminant_sums(samples: DataFrame, label: str, channels: list[str] = CHANNELS) -> DataFrame:
    """Within- and between-class scatter as one row of sums: w_i_j and b_i_j for i <= j. Any number of classes; k * k numbers are left."""
    pairs = [(i, j) for i in range(len(channels)) for j in range(i, len(channels))]
    by_class = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(channels)], *[F.sum(F.col(channels[i]) * F.col(channels[j])).alias(f"p{i}_{j}") for i, j in pairs])
    cross = lambda i, j: F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("n"))
    return by_class.agg(
        *[(F.sum(f"p{i}_{j}") - cross(i, j)).alias(f"w_{i}_{j}") for i, j in pairs],
        *[(cross(i, j) - F.sum(f"s{i}") * F.sum(f"s{j}") / F.sum("n")).alias(f"b_{i}_{j}") for i, j in pairs],
    )

