"""Folders that driver and executors share, and small files in them, on any file system that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; local sessions that name none have their own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="traceforge-work-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files of no bytes, which Spark's readers pass over without a word."""
    p, fs = _fs(spark, pattern)
    return [s.getPath().toString() for s in fs.globStatus(p) or [] if s.isFile() and not s.getLen()]


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    """Put a whole small file in place by one rename, so that readers see the old or the new one. False if it is there and mustn't be replaced."""
    whole = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, whole, text)
    fs = spark._jvm.org.apache.hadoop.fs
    src, _ = _fs(spark, whole)
    dst, at = _fs(spark, path)
    if not replace and at.exists(dst):
        delete(spark, whole)
        return False
    option = getattr(fs, "Options$Rename").OVERWRITE if replace else getattr(fs, "Options$Rename").NONE
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = option
    try:
        fs.FileContext.getFileContext(at.getUri(), at.getConf()).rename(src, dst, options)
    except Exception as e:
        delete(spark, whole)
        if not replace and at.exists(dst):
            return False
        raise e
    return True
