"""Tables in text form: standard-peak CSVs, reference positions, ground truth, chromatogram CSVs, settings."""

from __future__ import annotations

import csv
import json
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import STANDARD_POSITIONS

IS_SCANS = [f"is_peak_{i}_scan" for i in range(1, 5)]


def standard_peaks_long(wide: DataFrame) -> DataFrame:
    """(folder, well, is_idx, scan) of a standard-peak table, sparse (a peak per row) or dense (a well per row): whole scans, in scan order."""
    scans = [c for c in wide.columns if c.endswith("_scan")]
    d = wide.select("folder", "well", *[F.col(c).cast("double") for c in scans]).unpivot(["folder", "well"], scans, "slot", "scan")
    d = d.where("scan IS NOT NULL AND NOT isnan(scan)").withColumn("scan", F.floor("scan").cast("long"))
    order = Window.partitionBy("folder", "well").orderBy("scan", "slot")
    return d.withColumn("is_idx", F.row_number().over(order)).select("folder", "well", "is_idx", "scan")


def read_standard_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Standard-peak CSVs of either layout."""
    return standard_peaks_long(spark.read.option("header", "true").csv(path))


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """Genotype CSVs: prediction as text ('FAIL' or a code), the code as a number where it is one, and the confidence."""
    d = spark.read.option("header", "true").csv(path)
    return d.select("folder", "well", "prediction", F.col("prediction").try_cast("int").alias("code"), F.col("confidence").try_cast("double").alias("confidence"))


def read_plate_results(spark: SparkSession, path: str) -> DataFrame:
    """Plate result CSVs with or without leading ``#`` lines: arrays of scans and areas; the plate is the file's name."""
    d = spark.read.option("comment", "#").option("header", "true").csv(path)
    numbers = lambda c, kind: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != ""), lambda x: x.try_cast(kind))
    return d.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("plate"), F.col("Well").alias("well"), F.col("N_Peaks").try_cast("int").alias("n_peaks"),
        F.col("MF").try_cast("double").alias("mf"), F.col("Status").alias("status"), numbers(F.col("Scans"), "int").alias("scans"), numbers(F.col("Norm_Areas"), "double").alias("areas"),
    )


def reference_positions(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(gene, ref_idx, ref_scan) of a JSON map from gene to places, or of the built-in one."""
    if path is None:
        rows = [(g, i + 1, p) for g, ps in STANDARD_POSITIONS.items() for i, p in enumerate(ps)]
        return spark.createDataFrame(rows, "gene string, ref_idx int, ref_scan long")
    kind = T.MapType(T.StringType(), T.ArrayType(T.LongType()))
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("gene", "p"))
    return d.select("gene", F.posexplode("p").alias("i", "ref_scan")).select("gene", (F.col("i") + 1).alias("ref_idx"), "ref_scan")


def references_for(plates: DataFrame, references: DataFrame) -> DataFrame:
    """References of each plate: of the genes whose name is part of the plate's, or the other way round, the longest; of equals the first by name.

    Genes are few (the distinct keys of a reference file), so each plate is compared with each gene.
    """
    genes = references.select("gene").distinct()
    hit = plates.select("plate").distinct().join(genes, F.contains("plate", F.col("gene")) | F.contains("gene", F.col("plate")))
    order = Window.partitionBy("plate").orderBy(F.desc(F.length("gene")), "gene")
    return hit.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k").join(references, "gene")


def _sheet(path: str, sheet: str | None) -> list[list[str]]:
    """Cells of one sheet of an .xlsx file, with the standard library."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet")]
        n = sheets.index(sheet) + 1 if sheet else 1
        rows = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{n}.xml")).iter(f"{{{ns['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{{{ns['m']}}}c"):
                col = 0
                for ch in "".join(x for x in c.get("r", "A") if x.isalpha()):
                    col = 26 * col + ord(ch) - 64
                v = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "") or ""
                cells[col - 1] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


def read_truth(spark: SparkSession, path: str, sheet: str | None = None, pairs: int = 8, rows: int = 12) -> DataFrame:
    """Ground truth (plate, well, genotype) of a small workbook or CSV: a plate's name, then ``rows`` rows of ``pairs`` (well, genotype) pairs.

    Cells that are no whole number are skipped. The workbook is a laboratory's hand-kept list, so the driver reads it.
    """
    if path.endswith(".xlsx"):
        table = _sheet(path, sheet)
    else:
        with open(path, newline="", encoding="utf-8") as f:
            table = list(csv.reader(f))
    out, i = [], 0
    while i < len(table):
        name = next((c.strip() for c in table[i] if "OY_" in c), None)
        if name is None:
            i += 1
            continue
        for row in table[i + 1 : i + 1 + rows]:
            for k in range(0, 2 * pairs, 2):
                try:
                    well, code = row[k].strip(), int(float(row[k + 1]))
                except (IndexError, ValueError):
                    continue
                if well:
                    out.append((name, well, code))
        i += rows + 1
    return spark.createDataFrame(out, "plate string, well string, genotype int")


def read_chromatograms(spark: SparkSession, path: str) -> DataFrame:
    """UTF-16 tab-separated chromatograms: (name, point, x, y). A file is read in one piece, as lines of two-byte characters can't be split by bytes."""
    d = spark.read.option("encoding", "UTF-16").option("multiLine", "true").option("sep", "\t").option("inferSchema", "false").schema("x string, y string").csv(path)
    d = d.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("name"), F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y")).where("y IS NOT NULL")
    return d.withColumn("point", F.row_number().over(Window.partitionBy("name").orderBy("x")) - 1)


def settings(path: str, defaults: dict) -> dict:
    """A settings file over defaults; unknown and missing keys are fine."""
    try:
        with open(path, encoding="utf-8") as f:
            return defaults | json.load(f)
    except FileNotFoundError:
        return dict(defaults)


def plates_like(plates: DataFrame, prefix: str, column: str = "plate") -> DataFrame:
    """Rows of the plates whose folder name starts so: a filter that reaches the scan, and prunes folders where plates are partitions."""
    return plates.where(F.startswith(F.col(column), F.lit(prefix)))
