"""Column builders for fixed-width operators along the scans of a well.

Every builder takes one window of a well's scans in order, so that a chain of them shares one
exchange and one sort.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import WELL


def scans(*more: str) -> WindowSpec:
    """A well's rows in scan order."""
    return Window.partitionBy(*WELL, *more).orderBy("scan")


def whole(*more: str) -> WindowSpec:
    """All rows of a well."""
    return Window.partitionBy(*WELL, *more)


def at(y: Column, k: int, w: WindowSpec) -> Column:
    """The value k scans on (before, if negative)."""
    return y if k == 0 else F.lead(y, k).over(w) if k > 0 else F.lag(y, -k).over(w)


def fit_rows(width: int, order: int = 2) -> np.ndarray:
    """Row i: weights of ``width`` equidistant samples whose least-squares polynomial is read at sample i."""
    a = np.vander(np.arange(width) - width // 2, order + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(y: Column, width: int, w: WindowSpec, n: Column, order: int = 2) -> Column:
    """Savitzky-Golay smoothing; at the ends the polynomial of the outermost ``width`` samples; raw if there are fewer."""
    rows, half = fit_rows(width, order), width // 2
    taps = lambda i, shift: reduce(add, [float(rows[i, j]) * at(y, j - shift, w) for j in range(width)])
    out = F.when(n < width, y)
    for i in range(half):
        out = out.when(F.col("scan") == i, taps(i, i)).when(F.col("scan") == n - 1 - i, taps(width - 1 - i, width - 1 - i))
    return out.otherwise(taps(half, half))


def rolling_min(y: Column, width: int, w: WindowSpec) -> Column:
    """Least value of a centred window that is cut at the ends."""
    return F.min(y).over(w.rowsBetween(-(width // 2), (width - 1) // 2))


def middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor(n / 2 + 1).cast("int"))) / 2


def unmixed(columns: list[str], matrix) -> list[Column]:
    """Each dye's intensity: the inverse of the channels-by-dyes matrix applied to the channels, negatives cut to 0."""
    inverse = np.linalg.inv(np.array(matrix, float))
    return [F.greatest(reduce(add, [float(inverse[i, j]) * F.col(c) for j, c in enumerate(columns)]), F.lit(0.0)) for i in range(len(columns))]


def argmax(columns: list[str]) -> Column:
    """Index of the greatest column, the first of equals."""
    return (F.array_position(F.array(*columns), F.greatest(*columns)) - 1).cast("int")
