"""The driver's tables seen as traces, samples, calls and names, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Queries = dict[str, tuple]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts of the traces for each split of their table.
PARTS_PER_SPLIT = 8


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as traces: a supplier is a well, its nation the plate, its lines in date order the scans.

    Wells are dealt to parts whose number follows the table's size, so that no task's share grows with it; what goes by well, or by plate (also one
    named anew) and well, and joins by well and scan stay on these parts instead of dealing every sample again.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    order = Window.partitionBy("plate", "well").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    plates = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("plate"))
    lines = table(spark, sf_dir, "lineitem")
    d = lines.join(plates, "l_suppkey").withColumnRenamed("l_suppkey", "well").repartition(PARTS_PER_SPLIT * max(1, lines.rdd.getNumPartitions()), "well")
    return d.select(
        "plate", "well", (F.row_number().over(order) - 1).cast("long").alias("scan"), F.col("l_extendedprice").alias("c1"), (F.col("l_quantity") * 1000).alias("c2"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("c3"), (F.col("l_extendedprice") * F.col("l_tax")).alias("c4"), F.col("l_quantity").alias("current"),
    )


def long(spark: SparkSession, sf_dir: str, channels: tuple[str, ...] = ("c1", "c2", "c3", "c4")) -> DataFrame:
    from ..operators.signal import to_long

    return to_long(trace(spark, sf_dir), list(channels))


def peaks(spark: SparkSession, sf_dir: str, channels: tuple[str, ...] = ("c1",)) -> DataFrame:
    """Local maxima."""
    from ..operators.peaks import local_maxima

    return local_maxima(long(spark, sf_dir, channels))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reference places on every plate."""
    places = F.posexplode(F.array(*[F.lit(p) for p in REFERENCE_SCANS])).alias("i", "ref_scan")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("plate")).distinct().select("plate", places).select("plate", (F.col("i") + 1).cast("long").alias("ref_idx"), F.col("ref_scan").cast("long").alias("ref_scan"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as four-channel samples of a base."""
    channels = [F.col("embedding")[i].cast("double").alias(f"c{i + 1}") for i in range(4)]
    base = F.element_at(F.array(*[F.lit(b) for b in "TGCA"]), (F.col("label") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), base.alias("base"), *channels)


REFERENCE_SCANS = (100, 200, 320, 420)

TR = """tr AS MATERIALIZED (
  SELECT CAST(s_nationkey AS BIGINT) AS plate, l_suppkey AS well,
    CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS scan,
    l_extendedprice AS c1, l_quantity * 1000 AS c2, l_extendedprice * l_discount AS c3, l_extendedprice * l_tax AS c4, l_quantity AS current
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def lg(*channels: str) -> str:
    return "lg AS (" + " UNION ALL ".join(f"SELECT plate, well, '{c}' AS channel, scan, {c} AS y FROM tr" for c in channels or ("c1", "c2", "c3", "c4")) + ")"


#: Runs of equal samples compared with the runs beside them.
PK = """ru AS (SELECT *, coalesce(lag(y) OVER w <> y, true) AS fresh, max(scan) OVER (PARTITION BY plate, well, channel) AS fin FROM lg WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan)),
rv AS (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a, lead(scan) OVER w - 1 AS e FROM ru WHERE fresh WINDOW w AS (PARTITION BY plate, well, channel ORDER BY scan)),
pk AS MATERIALIZED (SELECT plate, well, channel, CAST((scan + e) // 2 AS BIGINT) AS scan, y AS height FROM rv WHERE y > b AND y > a)"""

RF = f"rf AS (SELECT plate, ref_idx, ref_scan FROM (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS plate FROM supplier), (VALUES {', '.join(f'(CAST({i + 1} AS BIGINT), CAST({p} AS BIGINT))' for i, p in enumerate(REFERENCE_SCANS))}) v(ref_idx, ref_scan))"

SM = "sm AS (SELECT vec_id, CAST(label AS BIGINT) AS label, substr('TGCA', CAST(label % 4 + 1 AS INTEGER), 1) AS base, CAST(embedding[1] AS DOUBLE) AS c1, CAST(embedding[2] AS DOUBLE) AS c2, CAST(embedding[3] AS DOUBLE) AS c3, CAST(embedding[4] AS DOUBLE) AS c4 FROM embeddings)"


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
