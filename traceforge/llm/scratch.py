"""Intermediate tables in the folder that driver and executors share.

A cluster names that folder in ``spark.checkpoint.dir``; only where it is unset and the master is
local (unit tests) does this module pick one itself: executors elsewhere could not read it.
Tables that no later step reads are deleted with ``spent``.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session that names none.
_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, as named by ``spark.checkpoint.dir``."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        named = _own.get(spark.sparkContext.applicationId)
        if not named:
            named = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="traceforge-")
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def view(table: DataFrame, df: DataFrame) -> DataFrame:
    """``df``, which reads ``table`` alone, as its stand-in for ``spent``."""
    _paths[df] = _paths[table]
    return df


def spent(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, on whatever file system they lie."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until it differs from all ``taken`` names, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
