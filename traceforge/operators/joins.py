"""Range, nearest and combination joins without Cartesian products."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_join(left: DataFrame, right: DataFrame, on: list[str], place: str, low: Column, high: Column, width: int, how: str = "inner", keys: list[str] | None = None) -> DataFrame:
    """Rows of ``left`` with those of ``right`` (column ``place``) that lie in [low, high] of the left row.

    Places are put in buckets of ``width``; a left row visits the buckets its interval touches, so the join is
    an equality on (on, bucket) that Spark can spread and split; the exact condition follows. ``how``: inner, left_semi or left_anti; for
    the last two ``keys`` name the columns that tell left rows apart (all of them if not given: equal rows share their fate).
    """
    to = lambda c: F.floor(c / width).cast("long")
    r = right.withColumn("_bucket", to(F.col(place)))
    l = left.withColumn("_low", low).withColumn("_high", high)
    if how == "inner":
        wide = l.where(F.col("_low") <= F.col("_high")).withColumn("_bucket", F.explode(F.sequence(to(F.col("_low")), to(F.col("_high")))))
        joined = wide.join(r, [*on, "_bucket"])
        return joined.where((F.col(place) >= F.col("_low")) & (F.col(place) <= F.col("_high"))).drop("_bucket", "_low", "_high")
    of = keys or left.columns
    wide = l.where(F.col("_low") <= F.col("_high")).select(*{*of, *on}, "_low", "_high", F.explode(F.sequence(to(F.col("_low")), to(F.col("_high")))).alias("_bucket"))
    hits = wide.join(r.select(*on, "_bucket", F.col(place).alias("_place")), [*on, "_bucket"]).where((F.col("_place") >= F.col("_low")) & (F.col("_place") <= F.col("_high")))
    if keys:
        return left.join(hits.select(*keys).distinct(), keys, how)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_hit_{c}")) for c in of])
    return left.join(hits.select(*[F.col(c).alias(f"_hit_{c}") for c in of]).distinct(), same, how)


def nearest(left: DataFrame, right: DataFrame, on: list[str], at: str, place: str, within: float, keys: list[str]) -> DataFrame:
    """Each left row (``keys``) with the right row whose ``place`` is nearest to ``at``, no farther than ``within``; of equals the lower place."""
    found = range_join(left, right, on, place, F.col(at) - within, F.col(at) + within, max(1, int(2 * within)))
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col(place) - F.col(at)), F.col(place))
    return found.withColumn("_pick", F.row_number().over(order)).where("_pick = 1").drop("_pick")


def by_group(left: DataFrame, right: DataFrame, keys: list[str], run: Callable, schema: str, arrow: bool = False) -> DataFrame:
    """``run`` on the rows of both frames that share ``keys`` (pandas frames, or with ``arrow`` Arrow tables); either side may derive from the other, as the right one's columns are named anew."""
    anew = right.select(*[F.col(c).alias(c) for c in right.columns])
    both = left.groupBy(*keys).cogroup(anew.groupBy(*keys))
    return both.applyInArrow(run, schema) if arrow else both.applyInPandas(run, schema)


def combinations4(points: DataFrame, group: list[str], place: str, score: str, spacing: float, span: float) -> DataFrame:
    """All four-point sets of a group with increasing places, neighbours at least ``spacing`` apart, first to last at least ``span``."""
    sets = points.select(*group, F.col(place).alias("p1"), F.col(score).alias("s1"))
    for k in (2, 3, 4):
        more = points.select(*group, F.col(place).alias(f"p{k}"), F.col(score).alias(f"s{k}"))
        sets = sets.join(more, group).where(F.col(f"p{k}") - F.col(f"p{k - 1}") >= spacing)
    return sets.where(F.col("p4") - F.col("p1") >= span)
