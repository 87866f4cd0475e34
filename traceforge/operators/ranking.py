"""Exact ranks within classes of any size, without a task that sees a whole class.

The order's columns are cut into ranges at bounded sets of quantiles. Rows are counted by class and range, counts are summed over
the ranges before, and a row's rank is that sum plus its place inside its range. A value that many rows share is itself
a cut and has a range of its own, which the next column cuts further; only rows equal in every column can crowd a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Ranges into which each column of the order is cut, about.
CUTS = 256


def _number(df: DataFrame, column: str) -> Column:
    """A number in the column's order (for texts of their first seven bytes), null for null."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("double")
    return F.col(column).cast("double")


def _place(number: Column, cuts: list[float]) -> Column:
    """Twice the cuts below a number, one more if it is a cut itself; -1 for null. A binary search, as the cuts are sorted."""
    steps = max(1, len(cuts).bit_length())
    table = F.array(*[F.lit(c) for c in cuts])
    half = lambda lo, hi: F.floor((lo + hi) / 2).cast("int")
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(table, half(s["lo"], s["hi"])) < number, F.struct((half(s["lo"], s["hi"]) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), half(s["lo"], s["hi"]).alias("hi"))),
        lambda s: s["lo"],
    )
    exact = F.coalesce(F.get(table, found) == number, F.lit(False)).cast("int")
    return F.when(number.isNull(), -1).otherwise(2 * found + exact)


def exact_rank(rows: DataFrame, by: list[str], order: list[str], rank: str = "rank", total: str = "total", cuts: int = CUTS) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in ``order`` (ascending, nulls first) within ``by`` (nulls are a class), and ``total``, the class's rows.

    At most ``cuts`` numbers a column of the order reach the driver. Rows equal in all of ``order`` have distinct ranks, in no set order.
    """
    numbers = {c: _number(rows, c) for c in order}
    shares = [i / cuts for i in range(1, cuts)]
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(n), n), shares, 10 * cuts).alias(c) for c, n in numbers.items()]).first()
    ranges = [f"_range{i}" for i in range(len(order))]
    d, single = rows, F.lit(True)
    for r, c in zip(ranges, order):
        edges = sorted(set(found[c] or []))
        here = _place(numbers[c], edges) if edges else F.when(numbers[c].isNull(), -1).otherwise(0)
        d = d.withColumn(r, F.when(single, here).otherwise(0))
        # Only a range of one value may be cut by the next column. A text's seven bytes don't name one value.
        whole = not isinstance(rows.schema[c].dataType, T.StringType | T.BinaryType)
        single = single & ((F.col(r) % 2 != 0) if whole else F.lit(False))
    counts = d.groupBy(*by, *ranges).agg(F.count(F.lit(1)).alias("_n"))
    # Windows over counts: a class has as many rows here as it has ranges.
    before = Window.partitionBy(*by).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, *ranges)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias(total))
    inside = Window.partitionBy(*by, *ranges).orderBy(*order)
    same = [d[c].eqNullSafe(placed[f"_of_{c}"]) for c in (*by, *ranges)]
    ranked = d.withColumn("_nth", F.row_number().over(inside))
    same = [ranked[c].eqNullSafe(placed[f"_of_{c}"]) for c in (*by, *ranges)]
    out = ranked.join(placed, same)
    return out.select(*[ranked[c] for c in rows.columns], (F.col("_before") + F.col("_nth")).alias(rank), total)
