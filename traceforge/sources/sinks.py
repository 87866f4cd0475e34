"""Writers: FASTA, base, peak, result and genotype CSVs, windows by variant, reference upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stencils as st
from ..operators.sequences import wrapped
from ..schema import M13_REFERENCE, WELL


def base_rows(calls: DataFrame) -> DataFrame:
    """Well, Position, Base, Quality, Probability (four places, or empty)."""
    p = F.when(F.col("probability").isNull(), "").otherwise(F.format_string("%.4f", "probability"))
    return calls.select(F.col("well").alias("Well"), F.col("position").cast("int").alias("Position"), F.col("base").alias("Base"), F.col("quality").alias("Quality"), p.alias("Probability"))


def fasta_rows(calls: DataFrame, chemistry: str) -> DataFrame:
    """One text per well: a header and the sequence in lines of 80."""
    item = F.struct("position", "base")
    d = calls.groupBy(*WELL).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["base"]), "").alias("seq"), F.floor(F.avg("quality")).cast("int").alias("q"))
    return d.select(*WELL, F.concat(F.format_string(f">%s chemistry={chemistry} avg_qual=%d\n", F.col("well").cast("string"), F.col("q")), wrapped(F.col("seq"))).alias("value"))


def summary_rows(summary: DataFrame) -> DataFrame:
    return summary.select("well", "total_calls", "n_count", F.format_string("%.1f", "n_rate").alias("n_rate"), "avg_quality")


def joined(values, digits: int):
    """An array as text: numbers rounded half to even, joined by semicolons."""
    return F.array_join(F.transform(values, lambda x: F.bround(x, digits).cast("string")), ";")


def plate_lines(results: DataFrame, plate: str, run: str, grade: str, limit: int, standard_fwhm: float, sample_fwhm: float, per_well: float) -> DataFrame:
    """A plate's result file as ordered text lines: two comment lines, the head, a line per well."""
    head = [f"# Plate,{plate},{run},Quality,{grade},FWHM_MAX,{limit}", f"# IS_median_FWHM,{standard_fwhm:.1f},Samp_median_FWHM,{sample_fwhm:.1f},IS_per_well,{per_well:.1f}", "Well,N_Peaks,MF,Status,Scans,Norm_Areas"]
    top = results.sparkSession.createDataFrame([(i, "", t) for i, t in enumerate(head)], "part long, well string, value string")
    line = F.concat_ws(",", "well", "n_peaks", F.format_string("%.4f", "mf"), "status", joined(F.col("scans"), 0), joined(F.col("areas"), 2))
    return top.unionByName(results.select(F.lit(len(head)).cast("long").alias("part"), F.col("well").cast("string").alias("well"), line.alias("value"))).orderBy("part", "well").select("value")


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A CSV folder with heads, in order where one is asked for."""
    (df.orderBy(*by) if by else df).write.mode("overwrite").option("header", "true").csv(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """Training windows as Parquet by variant."""
    windows.write.mode("overwrite").partitionBy("variant").parquet(path)


def dense_standards(peaks: DataFrame, n: int = 4) -> DataFrame:
    """One row per well: scan and height of each standard peak."""
    d = peaks.groupBy("folder", "well").pivot("is_idx", list(range(1, n + 1))).agg(F.first("scan").alias("scan"), F.first("height").alias("height"))
    names = {f"{i}_{c}": f"is_peak_{i}_{c}" for i in range(1, n + 1) for c in ("scan", "height")}
    return d.withColumnsRenamed(names)


def sparse_standards(peaks: DataFrame, n: int = 4) -> DataFrame:
    """One row per standard peak, its scan in the column of its number."""
    return peaks.select("folder", "well", *[F.when(F.col("is_idx") == i, F.col("scan")).alias(f"is_peak_{i}_scan") for i in range(1, n + 1)])


def upserted_references(old: DataFrame, new: DataFrame) -> DataFrame:
    """References with those of the new genes put in their place."""
    return old.join(new.select("gene").distinct(), "gene", "left_anti").unionByName(new)


def write_reference(spark: SparkSession, path: str, sequence: str = M13_REFERENCE, width: int | None = None) -> None:
    """A reference sequence as a text folder: one line, or lines of ``width``."""
    line = F.lit(sequence) if width is None else wrapped(F.lit(sequence), width)
    spark.range(1).select(line.alias("value")).write.mode("overwrite").text(path)


def gene_of(folder):
    """The gene a folder is named after: the part of its name that follows the prefix ``OY_`` (or ``oy_``), else its whole name."""
    return F.when(F.startswith(folder, F.lit("OY_")) | F.startswith(folder, F.lit("oy_")), F.try_element_at(F.split(folder, "_"), F.lit(2))).otherwise(folder)


def evaluation_json(stats: DataFrame) -> DataFrame:
    """One JSON text per row of an evaluation table."""
    return stats.select(F.to_json(F.struct("*")).alias("value"))


def display_rows(trace: DataFrame) -> DataFrame:
    """What a viewer draws: channels, current over ten, and the height of a peak's marker."""
    top, low = F.max("c1").over(st.whole()), F.min("c1").over(st.whole())
    return trace.withColumns({"current_10": F.col("current") / 10, "marker": F.col("c1") + 0.03 * (top - low)})
