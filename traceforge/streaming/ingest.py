"""Streams: traces as they are dropped in a folder, and gap groups of events in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.rsd import RSD, place, trace_records


def dropped_traces(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of trace rows: each new .rsd file under ``folder`` once."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rec = trace_records(r.content)
                if len(rec):
                    yield pd.DataFrame({"plate": r.plate, "well": r.well, "scan": range(len(rec)), **{f"channel{i}": rec[:, i] for i in range(1, 5)}, "current": rec[:, 0], "_corrupt": None})

    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.rsd").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.withColumns(place(F.col("path"))).select("plate", "well", "content").mapInPandas(run, RSD)


def land(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of traces to Parquet by plate; what is there when it starts is taken, then it ends."""
    return stream.writeStream.format("parquet").partitionBy("plate").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_groups(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key's events with pauses of at most ``gap``: count, first and last time. Streams end a session once ``late`` has passed."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    s = F.session_window(time, gap)
    return d.groupBy(key, s.alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")).drop("s")


def rolling_totals(events: DataFrame, time: str, width: str, by: str, late: str) -> DataFrame:
    """Counts and sums of events in tumbling windows, with a watermark on streams."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    return d.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
