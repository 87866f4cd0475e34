"""Binary traces (.rsd), vendor base calls (.esd) and text traces (.txt), read by Spark's file sources.

Plate, well and caller come from the path. Files that cannot be read give a row in ``_corrupt`` instead of vanishing.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import RSD_CEILING

# Fixed formats: anchors and tags of the binary files.
ANCHORS = (b"\x05\tBAR CODE\0", b"\x05\x0cBASE CALLER\0")
HEADER_TAGS = (
    "BAR CODE", "BASE CALLER", "CHEMISTRY", "APPLICATION", "BEAMSPLITTER A", "BEAMSPLITTER B", "CHANNEL1", "CHANNEL2", "CHANNEL3", "CHANNEL4",
    "LASER MODE", "NAME", "COMMENT", "MACHINE ID", "PLATE ID", "SAMPLE NAME", "WELL ID", "BASE", "DYE", "FILTER",
)
TEXT_TAGS = ("SAMPLE NAME", "WELL ID", "CHEMISTRY", "DYE SET", "PLATE ID", "INSTRUMENT", "BAR CODE")
NUMBER_TAGS = ("PEAK POSITIONS", "BASES POSITIONS", "QUALITY SCORES", "QUALITY INDEX", "FWHM VALUES", "SPACING")
RSD = "plate string, well string, scan int, channel1 long, channel2 long, channel3 long, channel4 long, current long, _corrupt string"
ESD = "plate string, well string, caller string, sequence string, positions array<long>, quality array<float>, spacing array<float>, fwhm array<float>, meta map<string,string>, _corrupt string"


def trace_records(raw: bytes, boundary: str = "ceiling", ceiling: int = RSD_CEILING) -> np.ndarray:
    """Records (current, four channels) up to the first with a value over the ceiling, or up to the metadata's anchor."""
    end = len(raw) // 20
    if boundary == "anchor":
        found = [i for i in (raw.find(a) for a in ANCHORS) if i >= 0]
        end = min(end, found[0] // 20) if found else end
    records = np.frombuffer(raw[: 20 * end], "<u4").reshape(-1, 5).astype(np.int64)
    if boundary == "ceiling":
        over = np.flatnonzero((records > ceiling).any(axis=1))
        records = records[: over[0]] if len(over) else records
    return records


def trace_header(raw: bytes, most: int = 200) -> dict[str, str]:
    """Metadata after the first anchor: known keys, each with the string that follows it (empty if a key follows), binary values skipped.

    Dyes and filters stand under the channel named before them: ``CHANNEL1_DYE``.
    """
    found, at = [], raw.find(ANCHORS[0])
    while 0 <= at < len(raw) - 3 and len(found) < most:
        if raw[at] != 5:
            at += 1
            continue
        body = raw[at + 2 : at + 2 + raw[at + 1]]
        found.append(body.split(b"\0")[0].decode("latin-1") if b"\0" in body else "")
        at += 2 + raw[at + 1]
    out: dict[str, str] = {}
    channel = key = None
    for text in found:
        if text not in HEADER_TAGS:
            if key:
                out[key] = text
            key = None
            continue
        if key:
            out[key] = ""
        if text.startswith("CHANNEL"):
            channel, key = text, None
        elif channel and text in ("DYE", "FILTER", "BASE"):
            key = f"{channel}_{text}" if text != "BASE" else None
        else:
            channel, key = None, text
    if key:
        out[key] = ""
    return out


def write_trace(records: np.ndarray, header: dict[str, str]) -> bytes:
    """Bytes of a trace file; reading them gives the records and header back."""
    tag = lambda s: b"\x05" + bytes([len(s) + 1]) + s.encode("latin-1") + b"\0"
    body = {"BAR CODE": header.get("BAR CODE", "")} | header
    return records.astype("<u4").tobytes() + b"".join(tag(k) + tag(v) for k, v in body.items())


def place(path: Column) -> dict[str, Column]:
    """Plate (the folder above) and well (the file's name) of a path."""
    return {"plate": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "well": F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)}


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.withColumns(place(F.col("path")))


def read_traces(spark: SparkSession, path: str, boundary: str = "ceiling") -> DataFrame:
    """All .rsd files under a folder as trace rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                try:
                    rec, bad = trace_records(r.content, boundary), None
                except Exception as e:  # noqa: BLE001 - a damaged file becomes a row that says so
                    rec, bad = np.zeros((0, 5), np.int64), f"{type(e).__name__}: {e}"
                if bad or not len(rec):
                    yield pd.DataFrame({"plate": [r.plate], "well": [r.well], "scan": [None], **{f"channel{i}": [None] for i in range(1, 5)}, "current": [None], "_corrupt": [bad or "no records"]})
                else:
                    yield pd.DataFrame({"plate": r.plate, "well": r.well, "scan": np.arange(len(rec)), **{f"channel{i}": rec[:, i] for i in range(1, 5)}, "current": rec[:, 0], "_corrupt": None})

    return _binary(spark, path, "*.rsd").select("plate", "well", "content").mapInPandas(run, RSD)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all .rsd files as a map."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"plate": pdf["plate"], "well": pdf["well"], "header": [trace_header(c) for c in pdf["content"]]})

    return _binary(spark, path, "*.rsd").select("plate", "well", "content").mapInPandas(run, "plate string, well string, header map<string,string>")


def base_file(raw: bytes) -> dict:
    """A vendor base-call file: its sequence, numeric arrays and texts; what is missing is null.

    The sequence is the first one of a plausible length: 101 to 4999 letters behind a two-byte length (type 6), or over 100 behind one byte (type 5).
    Numbers count whatever type byte stands before their two-byte length.
    """
    out: dict = {"sequence": None, "meta": {}}
    for m in re.finditer(rb"SEQUENCE\0(?:\x06(..)|\x05(.))", raw, re.S):
        n = int.from_bytes(m[1] or m[2], "little")
        if 100 < n < 5000:
            out["sequence"] = re.sub("[^ACGTN]", "", raw[m.end() : m.end() + n].decode("latin-1").upper()) or None
            break
    for tag in TEXT_TAGS:
        i = raw.find(tag.encode() + b"\0\x05")
        if i >= 0:
            i += len(tag) + 2
            out["meta"][tag] = raw[i + 1 : i + 1 + raw[i]].split(b"\0")[0].decode("latin-1")
    for tag in NUMBER_TAGS:
        i = raw.find(tag.encode() + b"\0")
        if 0 <= i <= len(raw) - len(tag) - 4:
            i += len(tag) + 2
            n = struct.unpack_from("<H", raw, i)[0]
            body = raw[i + 2 : i + 2 + n]
            if body and len(body) % 4 == 0:
                words = np.frombuffer(body, "<u4")
                whole = tag.endswith("POSITIONS") and 100 < words[0] < 100000
                out[tag] = words.astype(np.int64).tolist() if whole else np.frombuffer(body, "<f4").tolist()
    return out


def write_base_file(sequence: str, numbers: dict[str, list], meta: dict[str, str]) -> bytes:
    """Bytes of a base-call file; reading them gives the parts back."""
    out = [b"SEQUENCE\0\x06" + struct.pack("<H", len(sequence)) + sequence.encode("latin-1")]
    out += [k.encode() + b"\0\x05" + bytes([len(v) + 1]) + v.encode("latin-1") + b"\0" for k, v in meta.items()]
    for k, v in numbers.items():
        body = np.array(v, "<u4" if k.endswith("POSITIONS") else "<f4").tobytes()
        out.append(k.encode() + b"\0\x06" + struct.pack("<H", len(body)) + body)
    return b"".join(out)


def read_base_files(spark: SparkSession, path: str) -> DataFrame:
    """All .esd files under a folder; the folder above a file names its caller, the one above that the plate. Peak positions come before base positions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    d, bad = base_file(r.content), None
                except Exception as e:  # noqa: BLE001 - a damaged file becomes a row that says so
                    d, bad = {"sequence": None, "meta": {}}, f"{type(e).__name__}: {e}"
                positions = d.get("PEAK POSITIONS") or d.get("BASES POSITIONS")
                rows.append((r.plate, r.well, r.caller, d["sequence"], [int(p) for p in positions] if positions else None, d.get("QUALITY SCORES"), d.get("SPACING"), d.get("FWHM VALUES"), d["meta"], bad))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in ESD.replace("map<string,string>", "m").split(", ")])

    d = _binary(spark, path, "*.esd").withColumns({"caller": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "plate": F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1)})
    return d.select("plate", "well", "caller", "content").mapInPandas(run, ESD)


def read_text_traces(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """All .txt traces under a folder: a free header, then a table whose head starts with Scan and names channels.

    Rows without a scan are dropped; cells that are no numbers are null, or 0 with ``legacy``.
    """
    d = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    d = d.withColumn("path", F.col("_metadata.file_path")).withColumns(place(F.col("path")))
    lines = d.select("plate", "well", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    is_head = F.startswith(F.trim("line"), F.lit("Scan")) & F.contains("line", F.lit("Channel"))
    file = Window.partitionBy("plate", "well")
    lines = lines.withColumn("head", F.min(F.when(is_head, F.struct("i", "line"))).over(file))
    cells = lambda c: F.split(F.trim(c), r"\s+")
    body = lines.where((F.col("i") > F.col("head.i")) & (F.trim("line") != "")).withColumns({"names": cells(F.col("head.line")), "cells": cells(F.col("line"))})
    value = lambda name: F.try_element_at("cells", F.nullif(F.array_position("names", name), F.lit(0)).cast("int")).try_cast("double")
    filled = lambda c: F.coalesce(c, F.lit(0.0)) if legacy else c
    out = body.select("plate", "well", value("Scan").alias("scan"), *[filled(value(f"Channel{k}")).alias(f"channel{k}") for k in range(1, 5)], filled(value("Current")).alias("current"))
    return out.where("scan IS NOT NULL")


def read_text_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header of all .txt traces: its ``key: value`` lines as a map, the others as a list."""
    d = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    d = d.withColumns(place(F.col("_metadata.file_path")))
    head = F.element_at(F.split("value", r"(?m)^\s*Scan\b.*Channel"), 1)
    lines = F.filter(F.transform(F.split(head, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
    entry = F.transform(pairs, lambda x: F.struct(F.trim(F.element_at(F.split(x, ":", 2), 1)).alias("k"), F.trim(F.element_at(F.split(x, ":", 2), 2)).alias("v")))
    unique = F.map_from_entries(F.filter(entry, lambda e: F.array_position(F.transform(entry, lambda f: f["k"]), e["k"]) == F.array_position(entry, e)))
    return d.select("plate", "well", unique.alias("header"), F.filter(lines, lambda x: ~F.contains(x, F.lit(":"))).alias("info"))


def preferred(traces: DataFrame, texts: DataFrame) -> DataFrame:
    """Binary traces, and text traces of the wells that have no binary one; only wells A01 to H12."""
    only = F.col("well").rlike("^[A-H](0[1-9]|1[0-2])$")
    columns = ["plate", "well", "scan", "channel1", "channel2", "channel3", "channel4", "current"]
    extra = texts.join(traces.select("plate", "well").distinct(), ["plate", "well"], "left_anti")
    as_ = lambda d: d.select("plate", "well", *[F.col(c).cast("double").alias(c) for c in columns[2:]])
    return as_(traces.where("_corrupt IS NULL")).unionByName(as_(extra)).where(only)
