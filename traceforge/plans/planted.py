"""A plate with known genotypes: the table's own traces with peaks of three evenly dealt classes added to their noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotype as gt
from ..schema import WELL
from . import views as v

#: A class's number and code: only the first channel's peak, only the second's, both.
CODES = (1, 2, 4)


def planted_plate(spark: SparkSession, sf: str) -> DataFrame:
    """Traces of three plates with ``label``, a class of three by the well's number: a bell at scan 200 in the first channel, the second, or both; in the standard's channel one of four bells moves with the class.

    Heights vary by well from six tenths up, amid samples as high as the bells themselves, so that no single figure gives the class away.
    """
    d = v.trace(spark, sf).withColumns({"label": F.pmod("well", F.lit(3)).cast("double"), "plate": F.pmod("plate", F.lit(3))})
    bell = lambda at, width: F.exp(-0.5 * ((F.col("scan") - at) / width) ** 2)
    vary = 0.6 + 0.4 * F.pmod(F.xxhash64("well", F.lit(1)), F.lit(100)) / 100
    top = bell(F.lit(200), 6.0) * 60_000 * vary
    standard = sum((bell(F.lit(at), 1.0) for at in (80, 160, 420)), bell(300 + 12 * F.col("label"), 1.0)) * 30_000 * vary
    return d.withColumns({"c1": F.col("c1") + F.when(F.col("label") != 1, top).otherwise(0), "c2": F.col("c2") + F.when(F.col("label") != 0, top).otherwise(0), "c3": F.col("c3") + standard})


def _code() -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("label") + 1).cast("int"))


def planted_labels(plate: DataFrame) -> DataFrame:
    """plate, well, label (0 to 2) and code (a genotype's) of each well."""
    return plate.groupBy(*WELL).agg(F.first("label").alias("label")).withColumn("code", _code())


def planted_features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Statistics and correlations of each planted well that lies on a plate, its label and code, from one pass and the percentiles'; and the features' names."""
    f = gt.trace_stats(planted_plate(spark, sf).dropna(subset=WELL), more=[*gt.correlation_columns(), F.first("label").alias("label")]).withColumn("code", _code())
    return f, sorted(c for c in f.columns if c not in (*WELL, "label", "code", "n_scans"))
