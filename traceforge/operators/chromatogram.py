"""Window grids of chromatograms: label encoding and decoding, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRID = 256


def encode(peaks: DataFrame, grid: int = GRID) -> DataFrame:
    """Labels of a peak table (id, loc in [0, 1), area): its cell, and its place inside the cell; of several in a cell the last counts, of these at one place the one of the greatest area."""
    d = peaks.withColumn("cell", F.least(F.floor(F.col("loc") * grid), F.lit(grid - 1)))
    order = Window.partitionBy("id", "cell").orderBy(F.desc("loc"), F.desc("area"))
    return d.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("id", "cell", F.lit(1.0).alias("p"), (F.col("loc") * grid - F.col("cell")).alias("rel"), "area")


def decode(cells: DataFrame, threshold: float = 0.5, grid: int = GRID) -> DataFrame:
    """Peaks of cells (id, cell, p, rel, area) over a threshold: loc = (cell + rel) / grid."""
    return cells.where(F.col("p") > threshold).select("id", ((F.col("cell") + F.col("rel")) / grid).alias("loc"), "area", "p")


def one_per_cell(peaks: DataFrame, grid: int = GRID) -> DataFrame:
    """The first peak of every cell, of several at one place the one of the greatest area."""
    order = Window.partitionBy("id", "_c").orderBy("loc", F.desc("area"))
    return peaks.withColumn("_c", F.floor(F.col("loc") * grid)).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_c", "_k")


def scaled_examples(signals: DataFrame, cells: DataFrame, seconds: float = 600) -> tuple[DataFrame, DataFrame]:
    """What a detector of cells learns from: signals (id, point, y) over their greatest value, and cells' areas over the same value times the length of a run.

    Where the greatest value is 0 the results are null. One aggregate by id serves both; it is joined back.
    """
    top = signals.groupBy("id").agg(F.max("y").alias("_top"))
    x = signals.join(top, "id").select("id", "point", F.try_divide("y", "_top").alias("x"))
    return x, cells.join(top, "id").withColumn("area", F.try_divide("area", "_top") * seconds).drop("_top")


def metrics(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rates and errors of predicted cells (truth, p, rel, rel_true, area, area_true), one aggregation."""
    hit, t = F.col("p") > threshold, F.col("truth") == 1
    both = t & (F.col("p") > 0.5)
    rate = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    return cells.agg(
        rate(hit & t, t).alias("tpr"), rate(hit & ~t, ~t).alias("fpr"), F.avg((hit == t).cast("double")).alias("accuracy"),
        F.avg(F.when(both, F.abs(F.col("rel") - F.col("rel_true")))).alias("mae_loc"),
        F.avg(F.when(both, F.try_divide(F.abs(F.col("area") - F.col("area_true")), F.abs("area_true")))).alias("mre_area"),
        F.avg(F.when(both, F.try_divide(F.abs(F.col("rel") - F.col("rel_true")), F.abs("rel_true")))).alias("mre_loc"),
    )


def auc(cells: DataFrame, bins: int = 1000) -> DataFrame:
    """Area under the ROC curve from counts by score bin (ties within a bin count half): only ``bins`` rows are ordered."""
    d = cells.groupBy(F.floor(F.col("p") * bins).alias("bin")).agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") != 1).alias("neg"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return d.agg(F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def loss(cells: DataFrame) -> DataFrame:
    """Mean cross-entropy of probabilities, and over true cells that of places and the relative error of areas."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-7)), F.lit(1 - 1e-7))
    bce = lambda t, p: -(F.col(t) * F.ln(clip(p)) + (1 - F.col(t)) * F.ln(1 - clip(p)))
    true = F.col("truth") == 1
    return cells.agg(F.avg(bce("truth", "p")).alias("prob"), F.avg(F.when(true, bce("rel_true", "rel"))).alias("loc"), F.avg(F.when(true, F.try_divide(F.abs(F.col("area") - F.col("area_true")), F.abs("area_true")))).alias("area"))
