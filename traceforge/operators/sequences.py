"""Sequences: cleaning, alignment, consensus and ranking of callers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as k

ALIGNMENT = "score long, query_start long, query_end long, ref_start long, ref_end long, aligned long, matches long, identity double, query_line string, ref_line string"


def cleaned(seq: Column) -> Column:
    """Only the letters A, C, G, T and N of either case, in upper case."""
    return F.upper(F.regexp_replace(seq, "[^ACGTNacgtn]", ""))


def wrapped(seq: Column, width: int = 80) -> Column:
    """A sequence in lines, as FASTA has it."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def align(queries: DataFrame, reference: str) -> DataFrame:
    """Local alignment of every row's ``sequence`` with one reference: Arrow batches, no shuffle; nulls align nowhere."""
    names = [f.split()[0] for f in ALIGNMENT.split(", ")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [k.align_local(s or "", reference) for s in pdf["sequence"]]
            yield pdf.reset_index(drop=True).join(pd.DataFrame(found, columns=names))

    return queries.mapInPandas(run, f"{schema}, {ALIGNMENT}")


def match_line(query: Column, ref: Column) -> Column:
    """A bar under equal letters of two alignment lines, else a space."""
    return F.array_join(F.zip_with(F.split(query, ""), F.split(ref, ""), lambda a, b: F.when((a == b) & (a != "-"), "|").otherwise(" ")), "")


def transferred_labels(aligned: DataFrame) -> DataFrame:
    """The reference base of every query position that an alignment of identity 0.5 or more covers: (keys, position, base)."""
    other = [c for c in aligned.columns if c in ("plate", "well", "variant")]
    d = aligned.where((F.col("identity") >= 0.5) & (F.length("sequence") >= 50))
    pairs = F.posexplode(F.arrays_zip(F.split("query_line", "").alias("q"), F.split("ref_line", "").alias("r")))
    d = d.select(*other, "query_start", "query_line", pairs.alias("i", "p")).withColumn("before", F.length(F.regexp_replace(F.substring(F.col("query_line"), F.lit(1), F.col("i")), "-", "")))
    return d.where((F.col("p.q") != "-") & (F.col("p.r") != "-")).select(*other, (F.col("query_start") + F.col("before")).alias("position"), F.col("p.r").alias("base"))


def consensus(votes: DataFrame, by: list[str], order: str, least: int = 2) -> DataFrame:
    """Base of each place with votes of ``least`` callers or more: the most votes of A, C, G and T, if ``least`` agree, else N; of equals the caller seen first (``order``) decides."""
    per_base = votes.where(F.col("base").isin(*"ACGT")).groupBy(*by, "base").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = per_base.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_first", "base"))).where("_k = 1")
    callers = votes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_votes")).where(F.col("n_votes") >= least)
    return callers.join(best.select(*by, "base", "n"), by, "left").select(*by, "n_votes", F.when(F.coalesce("n", F.lit(0)) >= least, F.col("base")).otherwise("N").alias("base"), F.coalesce("n", F.lit(0)).alias("n_agree"))


def agreement(labels: DataFrame, by: list[str], least: int) -> DataFrame:
    """Places where at least ``least`` labels agree, with that label (the lowest of equals)."""
    n = labels.groupBy(*by, "base").agg(F.count(F.lit(1)).alias("agree"))
    best = n.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("agree"), "base"))).where("_k = 1").drop("_k")
    return best.where(F.col("agree") >= least)


def identity_stats(aligned: DataFrame, by: str) -> DataFrame:
    """Mean, median, least, greatest and deviation of identities by caller, zeros left out, best first."""
    d = aligned.where("identity > 0").groupBy(by)
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("identity").alias("mean"), F.percentile("identity", F.lit(0.5)).alias("median"), F.min("identity").alias("least"), F.max("identity").alias("greatest"), F.stddev_pop("identity").alias("deviation"))


def ranked(stats: DataFrame, by: str, value: str = "mean") -> DataFrame:
    """Callers with their rank; one row per caller, so one task orders them."""
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), by)))
