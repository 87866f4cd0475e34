"""Edit logs with undo and redo, by stack depth.

An edit goes one level up and forgets what lies above; undo goes a level down, if there is one; redo goes up again, as
far as the last edit went. So a log's state is its last depth and, on every level up to it, the last edit that was made there. Depths
are one pass of two counters over a key's ordered events, whatever their number; the rest are aggregates that combine. On a stream
the same counters and levels are a key's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UNDO, REDO = "undo", "redo"


def walk(ops: list[str], depth: int = 0, reach: int = 0, floor: int = 0, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, reach of redo, and floor of undo after each event. With ``most``, only so many levels can be undone: an edit on top of them raises the floor."""
    out = np.empty((3, len(ops)), np.int64)
    for i, op in enumerate(ops):
        if op == UNDO:
            depth -= depth > floor
        elif op == REDO:
            depth += depth < reach
        else:
            depth += 1
            reach = depth
            if most is not None and depth - floor > most:
                floor = depth - most
        out[0, i], out[1, i], out[2, i] = depth, reach, floor
    return out[0], out[1], out[2]


def depths(log: DataFrame, by: list[str], order: str, most: int | None = None) -> DataFrame:
    """Each event (``op``, ``edit``) with its place ``nth`` in its key's log, and the depth and floor after it. Events of one ``order`` go by op, then edit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "op", "edit"], kind="stable")
        depth, _, floor = walk(pdf["op"].tolist(), most=most)
        return pdf.assign(nth=np.arange(len(pdf)), depth=depth, floor=floor)[[*by, "nth", "op", "edit", "depth", "floor"]]

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*by).schema)
    return log.select(*by, order, "op", F.col("edit").cast("string").alias("edit")).groupBy(*by).applyInPandas(run, f"{keys}, nth long, op string, edit string, depth long, floor long")


def _levels(log: DataFrame, by: list[str], order: str, most: int | None) -> DataFrame:
    """Per key and level: its last event there, its last edit there, and the floor then."""
    d = depths(log, by, order, most)
    made = F.when(~F.col("op").isin(UNDO, REDO), F.struct("nth", "edit"))
    return d.groupBy(*by, "depth").agg(F.max(F.struct("nth", "floor")).alias("_seen"), F.max(made).alias("_made"))


def standing_edits(log: DataFrame, by: list[str], order: str, most: int | None = None) -> DataFrame:
    """The edits that stand at a log's end: by, level (from 1), edit. Those below the floor of ``most`` stand too, but can't be undone."""
    levels = _levels(log, by, order, most)
    last = levels.groupBy(*by).agg(F.max_by("depth", "_seen.nth").alias("_depth"))
    return levels.join(last, by).where((F.col("depth") <= F.col("_depth")) & F.col("_made").isNotNull()).select(*by, F.col("depth").alias("level"), F.col("_made.edit").alias("edit"))


def folded_edits(log: DataFrame, by: list[str], order: str, most: int | None = None) -> DataFrame:
    """Per key: n_standing, the edits that undo could take back, and last_standing, the one it would take back next (null without any)."""
    levels = _levels(log, by, order, most)
    end = F.max_by(F.struct("depth", "_seen.floor", "_made.edit"), "_seen.nth").alias("_end")
    n = (F.col("_end.depth") - F.col("_end.floor")).alias("n_standing")
    return levels.groupBy(*by).agg(end).select(*by, n, F.when(n > 0, F.col("_end.edit")).alias("last_standing"))


class EditState(StatefulProcessor):
    """A key's counters, and the last edit of each level, across batches of a stream."""

    def __init__(self, by: list[str], order: str, most: int | None) -> None:
        self.by, self.order, self.most = by, order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "depth long, reach long, floor long")
        self.levels = handle.getMapState("levels", "level long", "edit string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values([self.order, "op", "edit"], kind="stable")
        at = self.counters.get() if self.counters.exists() else (0, 0, 0)
        ops, edits = pdf["op"].tolist(), pdf["edit"].tolist()
        depth, reach, floor = walk(ops, *at, most=self.most)
        made = {int(d): e for d, op, e in zip(depth, ops, edits) if op not in (UNDO, REDO)}
        for level, edit in made.items():
            self.levels.updateValue((level,), (edit,))
        end, far, low = int(depth[-1]), int(reach[-1]), int(floor[-1])
        self.counters.update((end, far, low))
        last = self.levels.getValue((end,))[0] if end > low else None
        yield pd.DataFrame({**{c: [v] for c, v in zip(self.by, key)}, "n_standing": [end - low], "last_standing": [last]})

    def close(self) -> None:
        pass


def folded_edit_stream(log: DataFrame, by: list[str], order: str, most: int | None = None) -> DataFrame:
    """``folded_edits`` of a stream, a key's new state whenever a batch has events of it (update mode). Batches must not step back in ``order``; needs the RocksDB state store."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.select(*by).schema)
    typed = log.select(*by, order, "op", F.col("edit").cast("string").alias("edit"))
    return typed.groupBy(*by).transformWithStateInPandas(EditState(by, order, most), f"{keys}, n_standing long, last_standing string", "Update", "None")
