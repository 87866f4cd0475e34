"""Queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Queries

MODULES = ("signal_queries", "peak_queries", "call_queries", "run_queries", "training_queries", "store_queries")


def _all() -> Queries:
    found: Queries = {}
    for m in MODULES:
        found |= import_module(f"traceforge.plans.{m}").QUERIES
    return found


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed traces, their local maxima over the noise, and each well's peak count."""
    from ..operators import peaks as pk
    from ..operators import signal as sg
    from . import views as v

    long = v.long(spark, sf_dir, ("c1",))
    smooth = sg.smooth(long, 7).withColumn("y", F.col("smooth")).drop("smooth")
    high = pk.local_maxima(smooth).join(sg.noise_level(long), ["plate", "well", "channel"]).where(F.col("height") >= F.greatest(F.lit(50.0), F.col("noise")))
    return high.groupBy("plate", "well").agg(F.count(F.lit(1)).alias("n_peaks"), F.round(F.max("height"), 3).alias("max_height"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _all().items() if s}
