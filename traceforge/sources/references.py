"""Reference places of standard peaks kept by gene: saved from a run, and as the JSON map that other tools read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders
from .sinks import gene_of
from .versions import VersionedTable

REFERENCES = "gene string, ref_idx int, ref_scan long"


def gene_rows(references: DataFrame, folder: str = "folder") -> DataFrame:
    """References of plates by the gene their folder is named after: of several plates of a gene the first by folder, all of its rows."""
    d = references.withColumn("gene", gene_of(F.col(folder))).where(F.col("gene").isNotNull() & (F.col("gene") != ""))
    first = d.groupBy("gene").agg(F.min(folder).alias("_first"))
    return d.join(first, "gene").where(F.col(folder) == F.col("_first")).select("gene", F.col("ref_idx").cast("int").alias("ref_idx"), F.col("ref_scan").cast("long").alias("ref_scan"))


def save_references(table: VersionedTable, references: DataFrame, current: DataFrame, folder: str = "folder") -> int:
    """Put a run's references in the place of those of the same genes.

    ``references`` (folder, ref_idx, ref_scan) are a plate's consistent places; a plate without any has, in their stead, the ``current`` standard
    peaks (folder, scan) shown for it, in scan order. Returns the version.
    """
    own = references.select(folder, F.col("ref_idx").cast("int").alias("ref_idx"), F.col("ref_scan").cast("long").alias("ref_scan"))
    places = current.join(own.select(folder).distinct(), folder, "left_anti").groupBy(folder).agg(F.array_sort(F.collect_set(F.col("scan").cast("long"))).alias("_p"))
    shown = places.select(folder, F.posexplode("_p").alias("_i", "ref_scan")).select(folder, (F.col("_i") + 1).cast("int").alias("ref_idx"), "ref_scan")
    return table.upsert(gene_rows(own.unionByName(shown), folder), ["gene"])


def export_json(spark: SparkSession, table: VersionedTable, path: str) -> None:
    """The whole map as one JSON file, put in place in one step. Genes are few: the driver holds a number per reference."""
    rows = table.read().groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("ref_idx", "ref_scan"))).alias("p")).collect()
    folders.publish_text(spark, path, json.dumps({r["gene"]: [p["ref_scan"] for p in r["p"]] for r in sorted(rows, key=lambda r: r["gene"])}, indent=1), replace=True)
