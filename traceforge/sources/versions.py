"""Tables that change by whole versions: upserts and appends that readers see at once or not at all.

A version is a small numbered file that lists the Parquet folders the table is made of. A change writes its folders first, then
claims the next number by one rename that never replaces: of two writers one wins, and the other starts again from
what the winner left. A writer that fails leaves folders nobody lists. Appends carry the batch they come from, and a batch that
is already in is left out, so a replayed ``foreachBatch`` writes its rows once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders

#: Times a change starts again after others got in before it.
TRIES = 20


@dataclass(frozen=True)
class Version:
    """What a version lists: Parquet folders under the table's, and the last batch of each source of appends."""

    number: int = 0
    parts: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table in ``root``: ``versions/00000001`` and so on, and ``data/``."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def version(self, number: int | None = None) -> Version:
        """The latest version, or a numbered one."""
        if number is None:
            number = max((int(n) for n in folders.names(self.spark, f"{self.root}/versions") if n.isdigit()), default=0)
        return Version(number, **json.loads(folders.read_text(self.spark, self._file(number)))) if number else Version()

    def read(self, number: int | None = None) -> DataFrame:
        parts = self.version(number).parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{p}" for p in parts])

    def replace(self, rows: DataFrame) -> int:
        """These rows alone."""
        return self._change(lambda now: ([self._write(rows)], now.batches))

    def append(self, rows: DataFrame, source: str | None = None, batch: int | None = None) -> int:
        """These rows too, unless this batch of this source, or a later one, is in. The version that has them."""
        written: list[str] = []

        def change(now: Version) -> tuple[list[str], dict[str, int]] | None:
            if source is not None and batch is not None and now.batches.get(source, -1) >= batch:
                return None
            if not written:
                written.append(self._write(rows))
            return [*now.parts, *written], now.batches | ({source: batch} if source is not None and batch is not None else {})

        return self._change(change)

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows of the same keys give way to these, whatever their number."""

        def change(now: Version) -> tuple[list[str], dict[str, int]]:
            old, new = self.read(now.number), self._typed(rows)
            given = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
            same = [old[k].eqNullSafe(given[f"_new_{k}"]) for k in keys]
            return [self._write(old.join(given, same, "left_anti").unionByName(new))], now.batches

        return self._change(change)

    def compact(self) -> int:
        """The same rows in one folder."""
        return self._change(lambda now: ([self._write(self.read(now.number))], now.batches) if len(now.parts) > 1 else None)

    def vacuum(self) -> None:
        """Delete folders and versions other than the latest: only while nobody reads older ones and nobody writes."""
        now = self.version()
        for n in folders.names(self.spark, f"{self.root}/data"):
            if n not in now.parts:
                folders.delete(self.spark, f"{self.root}/data/{n}")
        for n in folders.names(self.spark, f"{self.root}/versions"):
            if n != f"{now.number:08d}":
                folders.delete(self.spark, f"{self.root}/versions/{n}")

    def batch_writer(self, source: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each batch of the stream once, also if it is replayed."""
        return lambda rows, batch: (self.append(rows, source, batch), None)[1]

    def _file(self, number: int) -> str:
        return f"{self.root}/versions/{number:08d}"

    def _typed(self, rows: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], self.schema).schema
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        self._typed(rows).write.parquet(f"{self.root}/data/{name}")
        return name

    def _change(self, change: Callable[[Version], tuple[list[str], dict[str, int]] | None]) -> int:
        for _ in range(TRIES):
            now = self.version()
            made = change(now)
            if made is None:
                return now.number
            parts, batches = made
            if folders.publish_text(self.spark, self._file(now.number + 1), json.dumps({"parts": parts, "batches": batches}), replace=False):
                return now.number + 1
        raise RuntimeError(f"{self.root}: others changed the table {TRIES} times in a row")
