"""Mixing sources to target weights by the cube method of balanced sampling.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating; together they get 150 %
of all words, none more than twice its own words, and what a full source cannot take is shared
again by weight. With T the words to share, the targets are ``min(cap, rate * weight)`` for the one
rate that makes them sum to T; sorted by cap / weight the full sources are a prefix, so one pass
over running sums finds the rate.

Each document of a source then expects ``target / source words`` copies: the whole part is given,
the fraction is an inclusion probability. The cube method moves the vector of fractions through
the null space of two constraints (words, documents) so that both totals stay exact while
fractions turn to 0 or 1, three open units at a time (the fast flight). Blocks of a source run on
their own, the few units each leaves open meet in a flight per group and then per source, and the
last ``LANDING`` units are rounded in the way that misses the word total least.

Blocks are cut by a hash of the document and a count of the source, never by file layout, and
steps draw from a hash of the document's id: reruns agree. Memory per task is one block of
(id, size, fraction) rows, no texts.

Rows and edge cases: a null text or one without words has size 0 and takes 0; a source with no words
has target 0; a repeated row (same source, doc_id and text) is a document of its own: m such rows share the whole part
of m times their expected copies as evenly as can be, and one fraction flies for them all, so they land as close as any
other document; an empty table gives an empty result; ties go by draws and ids. ``mix_plan`` reads doc_id, source
and text alone; ``mixed_rows`` keeps all columns, of any name.
"""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import fresh, spent, written

WEIGHTS, SHARE, MOST_COPIES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Repeated rows that are listed at a time.
TOGETHER = 4096
#: Rows of a block of the first flight; blocks that meet in one flight of the second; open units left to the landing.
BLOCK, FANOUT, LANDING = 4_000, 2_000, 10
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its words, its number of distinct rows and its target. ``sizes`` has source, size and n_rows."""
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    # One row per source in a single window: sources, not documents, set its size.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", MOST_COPIES * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("total", SHARE * F.sum("source_size").over(every))
    s = s.withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source whose cap isn't reached at its rate sets the rate of all that follow.
    rate = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct("pos", "rate"))).over(every)["rate"]
    s = s.withColumn("pos", F.row_number().over(by_fill)).withColumn("rate", rate)
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap"))))
    return s.select("source", "source_size", "n_units", target.alias("target"))


def flight(p: np.ndarray, words: np.ndarray, docs: np.ndarray, draws: np.ndarray, left: int = 2) -> np.ndarray:
    """Move fractions until at most ``left`` (2 or more) are open; sums of p * words and p * docs don't change."""
    eps = 1e-9
    v, s, m = p.tolist(), words.astype(float).tolist(), docs.astype(float).tolist()
    waiting = iter([i for i, x in enumerate(v) if eps < x < 1 - eps])
    open_ = sum(eps < x < 1 - eps for x in v)
    have: list[int] = []
    while open_ > max(2, left):
        while len(have) < 3:
            have.append(next(waiting))
        a, b, c = have
        # The null space of the rows (docs) and (words) of the three units.
        u = (m[b] * s[c] - m[c] * s[b], m[c] * s[a] - m[a] * s[c], m[a] * s[b] - m[b] * s[a])
        if not any(u):  # the three are alike in both
            u = (1 / m[a], -1 / m[b], 0.0)
        up = min((1 - v[i]) / d if d > 0 else v[i] / -d for i, d in zip(have, u) if d)
        down = min(v[i] / d if d > 0 else (1 - v[i]) / -d for i, d in zip(have, u) if d)
        step = up if draws[a] * (up + down) < down else -down
        still = []
        for i, d in zip(have, u):
            v[i] += step * d
            if eps < v[i] < 1 - eps:
                still.append(i)
            else:
                v[i] = float(round(v[i]))
                open_ -= 1
        have = still
    return np.array(v, float)


def landing(p: np.ndarray, words: np.ndarray, docs: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round the last open fractions: the least miss of the word total, then of the document total, then the draws."""
    at = [i for i, x in enumerate(p) if 1e-9 < x < 1 - 1e-9]
    out = np.round(p)
    if at:
        w, m, d = words[at].astype(float), docs[at].astype(float), draws[at]
        want_words, want_docs = float(p[at] @ w), float(p[at] @ m)
        z = np.array(list(itertools.product((0.0, 1.0), repeat=len(at))))
        miss = np.round(np.abs(z @ w - want_words), 6), np.round(np.abs(z @ m - want_docs), 6), np.abs(z - d).sum(1)
        out[at] = z[np.lexsort(miss[::-1])[0]]
    return out


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "doc_id", "size", "hash"], na_position="last", kind="stable")
        words, draws = pdf["size"].to_numpy(), pdf["draw"].to_numpy()
        docs = np.ones(len(pdf))
        p = flight(pdf["p"].to_numpy(), words, docs, draws, LANDING if last else 2)
        return pdf.assign(p=landing(p, words, docs, draws) if last else p)

    return run


def _plan(documents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``mix_plan``, and the written tables that it reads."""
    sizes = written(
        documents.groupBy("source", "doc_id", F.xxhash64("text").alias("hash")).agg(F.max(n_words(F.col("text"))).alias("size"), F.count(F.lit(1)).alias("n_rows")),
        "mix-sizes",
    )
    # One row per source; Spark broadcasts the written table only if its file is below the session's threshold.
    targets = written(source_targets(sizes), "mix-targets").withColumnRenamed("source", "of_source")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    expected = rate * F.col("n_rows")
    units = (
        sizes.join(targets, sizes["source"].eqNullSafe(F.col("of_source")))
        .drop("of_source")
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(expected + 1e-9)).otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(expected - F.col("whole"), F.lit(0.0))).otherwise(0.0))
        .withColumn("place", F.xxhash64("doc_id", "hash"))
        .withColumn("draw", F.pmod("place", F.lit(1 << 30)) / float(1 << 30))
        .withColumn("block", F.pmod(F.shiftrightunsigned("place", 30), F.ceil(F.col("n_units") / BLOCK)).cast("long"))
        .drop("place")
    )
    flown, schema = units, units.schema
    done, tables = [], []
    for name, keys, last in (
        ("block", ["source", "block"], False),
        ("group", ["source", F.floor(F.col("block") / FANOUT)], False),
        ("source", ["source"], True),
    ):
        flown = written(flown.groupBy(*keys).applyInPandas(_fly(last), schema), f"mix-{name}")
        tables.append(flown)
        is_open = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
        done.append(flown.where(~is_open))
        flown = flown.where(is_open)
    spent(sizes, targets)
    plan = done[0].unionByName(done[1]).unionByName(done[2])
    return plan.select("source", "doc_id", "hash", "size", "n_rows", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies")), tables


def mix_plan(documents: DataFrame) -> DataFrame:
    """Per distinct row (source, doc_id, text hash): n_rows alike, size, source_size, target and the copies of all of them together."""
    return _plan(documents)[0]


def _share(copies: Column, rows: Column, place: Column) -> Column:
    """What the row at a place (from 0) among equal ones gets of their copies."""
    return (F.floor(copies / rows) + F.when(place < copies % rows, 1).otherwise(0)).cast("long")


def mix(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    plan = mix_plan(documents)
    # Equal rows are listed TOGETHER at a time, the many of one document over several tasks.
    few = plan.where(F.col("n_rows") <= TOGETHER).withColumn("first", F.lit(0).cast("long"))
    many = plan.where(F.col("n_rows") > TOGETHER).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(TOGETHER).cast("long")))).repartition("doc_id", "hash", "first")
    rows = few.unionByName(many).withColumn("place", F.explode(F.sequence("first", F.least(F.col("first") + TOGETHER, F.col("n_rows")) - 1)))
    rows = rows.withColumn("copies", _share(F.col("copies"), F.col("n_rows"), F.col("place")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it, with all their columns."""
    plan = _plan(documents)[0].where("copies > 0")
    names = documents.columns
    source, doc, hash_, copies, rows, place, of = (fresh(names, c) for c in ("of_source", "of_doc", "of_hash", "of_copies", "of_rows", "place_", "text_hash"))
    plan = plan.select(F.col("source").alias(source), F.col("doc_id").alias(doc), F.col("hash").alias(hash_), F.col("copies").alias(copies), F.col("n_rows").alias(rows))
    d = documents.withColumn(of, F.xxhash64("text"))
    same = (d[of] == F.col(hash_)) & d["doc_id"].eqNullSafe(F.col(doc)) & d["source"].eqNullSafe(F.col(source))
    repeated = not plan.where(F.col(rows) > 1).isEmpty()
    taken = d.join(plan.where(F.col(rows) == 1) if repeated else plan, same)
    if repeated:
        # Equal rows are numbered: by the task that wrote them, then inside that task's rows. Both are fixed once written.
        again = written(d.join(plan.where(F.col(rows) > 1), same).withColumn(place, F.monotonically_increasing_id()), "mix-repeated")
        key, task = [source, doc, hash_], fresh([*again.columns], "task")
        again = again.withColumn(task, F.shiftright(place, 33))
        before = Window.partitionBy(*key).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
        counts = again.groupBy(*key, task).agg(F.count(F.lit(1)).alias("n")).select(*[F.col(c).alias(f"{c}_k") for c in (*key, task)], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_k"))
        inside = F.row_number().over(Window.partitionBy(*key, task).orderBy(place)) - 1
        numbered = again.withColumn(place, inside).join(counts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in (*key, task)]))
        numbered = numbered.withColumn(copies, _share(F.col(copies), F.col(rows), F.col(place) + F.col("before_k")))
        taken = taken.select(*names, copies).unionByName(numbered.where(F.col(copies) > 0).select(*names, copies))
    return taken.withColumn(of, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*names)
