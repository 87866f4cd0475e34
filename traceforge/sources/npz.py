"""Training windows as ``.npz`` archives, for tools that read numpy files.

``windows`` are rows of variant, well, position, label, quality and one array per channel. An archive holds ``X`` (windows by scans by
channels), ``y``, ``positions``, ``quality``, ``wells`` (text of fixed width) and, in merged files, ``variant``. Writing is a
data source of its own: tasks stream rows, parting them by variant, into archives of at most ``rows_per_file`` windows under a
temporary name; the driver renames them once all tasks are done, and a failed job leaves none. Reading goes by Spark's ``binaryFile``: each
archive is one row, its directory and array headers are checked against each other before any window comes out,
and clipped or mixed up ones are refused with their name. Arrays of Python objects are never unpickled: ``wells`` of that kind are null.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..schema import CHANNELS
from . import folders

MERGED = "all_variants"
#: Quality of windows in archives without any.
DEFAULT_QUALITY = 30.0
#: Windows in a file at most, and in an Arrow batch read from one.
ROWS_PER_FILE, ROWS_PER_BATCH = 50_000, 2_048


def _file_system(path: str):
    """pyarrow's file system for a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One compressed archive."""
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


@dataclass
class _Done(WriterCommitMessage):
    files: list[tuple[str, str]]


class NpzWriter(DataSourceArrowWriter):
    """Windows in any order to archives of each variant and, if ``merged``, to those of all, in one pass.

    A task holds at most ``rows_per_file`` windows for the merged file at hand, and as many for the variants' files together.
    """

    def __init__(self, path: str, merged: bool, rows_per_file: int, run: str) -> None:
        self.path, self.merged, self.rows_per_file, self.run = path, merged, rows_per_file, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        from pyspark import TaskContext

        system, root = _file_system(self.path)
        task, files = TaskContext.get(), []
        every: dict[None, list[pa.RecordBatch]] = {}
        single: dict[str, list[pa.RecordBatch]] = {}
        rows = lambda parts: sum(p.num_rows for p in parts)

        def put(held: dict, of: str | None) -> None:
            t, stem = pa.Table.from_batches(held.pop(of)), MERGED if held is every else str(of)
            name = f"{stem}.part-{task.partitionId():05d}-{len(files):03d}.npz"
            hidden = f"_{self.run}.{task.taskAttemptId()}.{name}"
            body = packed(_arrays(t, held is every))
            with system.open_output_stream(f"{root}/{hidden}") as f:
                f.write(body)
            files.append((hidden, name))

        def add(held: dict, of: str | None, part: pa.RecordBatch) -> None:
            at = 0
            while at < part.num_rows:
                free = self.rows_per_file - sum(map(rows, held.values()))
                if not free:
                    put(held, max(held, key=lambda k: rows(held[k])))
                    continue
                held.setdefault(of, []).append(part.slice(at, free))
                at += min(free, part.num_rows - at)

        for b in iterator:
            if self.merged:
                add(every, None, b)
            variants = b.column("variant")
            for v in variants.unique().to_pylist():
                add(single, v, b.filter(pc.equal(variants, v) if v is not None else pc.is_null(variants)))
        for held in (every, single):
            for of in list(held):
                put(held, of)
        return _Done(files)

    def commit(self, messages: list[_Done | None]) -> None:
        system, root = _file_system(self.path)
        for m in messages:
            for hidden, name in m.files if m else []:
                system.move(f"{root}/{hidden}", f"{root}/{name}")
        self._clean(system, root)

    def abort(self, messages: list[_Done | None]) -> None:
        self._clean(*_file_system(self.path))

    def _clean(self, system, root: str) -> None:
        """What lost or repeated tasks of this run left."""
        from pyarrow import fs

        for f in system.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith(f"_{self.run}."):
                system.delete_file(f.path)


def _arrays(t: pa.Table, merged: bool) -> dict[str, np.ndarray]:
    """The archive's arrays. Windows of different lengths, or with nulls, have no common shape and raise."""
    n = t.num_rows
    channels = [c for c in t.column_names if c.startswith("x_")]
    parts = []
    for c in channels:
        lists = t.column(c).combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        if lists.null_count or flat.null_count or len(set(size.tolist())) > 1:
            raise ValueError(f"windows of {c} have no common length")
        parts.append(flat.to_numpy().reshape(n, -1))
    words = lambda c: np.array([x or "" for x in t.column(c).to_pylist()])
    out = {"X": np.stack(parts, axis=2), "y": t.column("label").to_numpy(), "positions": t.column("position").to_numpy(), "quality": t.column("quality").to_numpy(), "wells": words("well")}
    return out | ({"variant": words("variant")} if merged else {})


class NpzSource(DataSource):
    """``df.write.format("npz-windows")``; options merged, rows_per_file."""

    @classmethod
    def name(cls) -> str:
        return "npz-windows"

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        system, root = _file_system(self.options["path"])
        system.create_dir(root, recursive=True)
        return NpzWriter(self.options["path"], self.options.get("merged", "false") == "true", int(self.options.get("rows_per_file", ROWS_PER_FILE)), uuid.uuid4().hex)


def write_npz(windows: DataFrame, path: str, merged: bool = True, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Archives of each variant, and merged ones of all, to a new folder that executors share.

    Tasks write the rows they have, so that no window is sorted or sent to another task; each file has its variant alone.
    """
    spark = windows.sparkSession
    spark.dataSource.register(NpzSource)
    channels = [f"x_{c}" for c in CHANNELS if f"x_{c}" in windows.columns]
    kinds = {"variant": "string", "well": "string", "position": "long", "label": "long", "quality": "double"} | dict.fromkeys(channels, "array<double>")
    typed = windows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    typed.write.format("npz-windows").option("merged", str(merged).lower()).option("rows_per_file", str(rows_per_file)).mode("append").save(path)


def _opened(path: str, content: bytes) -> tuple[dict[str, np.ndarray], list[str]]:
    """An archive's arrays, and the names of those that hold objects; ``ValueError`` with the file's name if it is broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            headers, arrays, objects = {}, {}, []
            for m in z.namelist():
                with z.open(m) as f:
                    major = np.lib.format.read_magic(f)
                    shape, _, kind = np.lib.format.read_array_header_1_0(f) if major == (1, 0) else np.lib.format.read_array_header_2_0(f)
                    headers[m.removesuffix(".npy")] = (shape, kind)
            rows = headers["y"][0]
            wrong = {k: s for k, (s, _) in headers.items() if s[:1] != rows}
            if len(rows) != 1 or wrong or len(headers["X"][0]) != 3:
                raise ValueError(f"shapes {wrong or headers} don't agree")
            for k, (_, kind) in headers.items():
                if kind.hasobject:
                    objects.append(k)
                    continue
                with z.open(f"{k}.npy") as f:
                    arrays[k] = np.lib.format.read_array(f, allow_pickle=False)
        return arrays, objects
    except (zipfile.BadZipFile, KeyError, EOFError, OSError, ValueError) as e:
        raise ValueError(f"{path} is no whole archive of windows: {e}") from e


def _read(batches: Iterable[pa.RecordBatch], names: list[str], channels: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            arrays, _ = _opened(path, content.as_py())
            x = arrays["X"].astype(np.float64)
            n, size, k = x.shape
            if k < len(channels):
                raise ValueError(f"{path} has {k} channels, not {len(channels)}")
            stem = path.rsplit("/", 1)[-1].removesuffix(".npz").split(".part-")[0]
            variants = arrays["variant"].astype(str) if "variant" in arrays else np.full(n, stem)
            wells = arrays["wells"].astype(str).tolist() if "wells" in arrays else [None] * n
            quality = arrays["quality"].astype(np.float64) if "quality" in arrays else np.full(n, DEFAULT_QUALITY)
            places = arrays["positions"].astype(np.int64) if "positions" in arrays else np.arange(n)
            for i in range(0, n, ROWS_PER_BATCH):
                j = min(n, i + ROWS_PER_BATCH)
                ends = pa.array(np.arange(0, (j - i) * size + 1, size, dtype=np.int32)) if size else pa.array(np.zeros(j - i + 1, np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x[i:j, :, c]).ravel())) for c in range(len(channels))]
                columns = [pa.array([path] * (j - i)), pa.array(variants[i:j].tolist(), pa.string()), pa.array(wells[i:j], pa.string()), pa.array(places[i:j]), pa.array(arrays["y"][i:j].astype(np.int64)), pa.array(quality[i:j]), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def read_npz(spark: SparkSession, path: str, variants: list[str] | None = None, channels: list[str] = CHANNELS) -> DataFrame:
    """Windows of the archives in a folder (or by a glob): file, variant, well, position, label, quality and an array per channel.

    ``variants`` picks files by name; by default all but the merged ones. Archives without quality have ``DEFAULT_QUALITY``.
    """
    if empty := folders.empty_files(spark, path if path.endswith(".npz") else f"{path.rstrip('/')}/*.npz"):
        raise ValueError(f"{empty[0]} is no whole archive of windows: it is empty")
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)(\.part-\d+-\d+)?\.npz$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    files = files.where(stem.isin(variants) if variants is not None else stem != MERGED)
    names = ["file", "variant", "well", "position", "label", "quality", *[f"x_{c}" for c in channels]]
    schema = "file string, variant string, well string, position long, label long, quality double, " + ", ".join(f"x_{c} array<double>" for c in channels)
    return files.mapInArrow(lambda it: _read(it, names, channels), schema)


def combined(windows: DataFrame, least_quality: float = 20, with_background: bool = True) -> DataFrame:
    """Archives put together for training: windows as long as those of the first file by name, of a quality over a limit; background (label 4) passes whatever its quality, or is left out."""
    from ..operators.learning import quality_filter

    first = windows.agg(F.min_by(F.size("x_c1"), "file").alias("_size"))
    return quality_filter(windows.join(first, F.size("x_c1") == F.col("_size")).drop("_size"), least_quality, with_background)
