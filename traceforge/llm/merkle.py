"""Merkle manifest of a table: leaves, subroots by group, one root, and every row's proof.

A node is the lowercase hex SHA-256 of its children's digests as text. Leaves are hashed where the table is read; from
there on only digests travel. Rows are numbered by one range exchange in (group, order) and one row per partition, so
no task holds a group, however large. ``SPAN`` levels of the tree share one exchange and one sort: rows lie by (group, block),
and each level is a window over (group, parent), the parent named by its digits, whose full frame, ordered by the next
digits, is ``collect_list`` of the nodes below. That list is the parent's preimage, and without the row's own node the row's
siblings. A node is listed by its first row alone, so a parent has each child once; after ``SPAN`` levels only the first row of a
block goes on as a node of the level above. Tables above are 1/256 of those below, until one node is left of each group;
the subroots go the same way to the root. What a block sees above it is joined back to its rows by (group, block).

Rows and edge cases: one row for each input row; repeated rows are leaves of their own; equal doc_ids ascend by
leaf (so ties of equal rows alone are left, whose order changes nothing); null doc_ids come first in their group; a null group comes first
of all; a group of one row has its leaf as subroot, a table of one row its leaf as root, and the proof of no sibling is
the digest of nothing; an empty table gives an empty result; columns beyond ``FIELDS``, of any name, are ignored. Long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fresh, spent, written

#: The leaf's fields in order, the group and the order within it.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels between two exchanges; a block is 2 ** SPAN nodes of a group.
SPAN = 8
#: Digests that a partition of the numbering holds, about.
PER_PARTITION = 2_000_000


def framed(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["l"], node, x["r"]))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf's level up, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""))


def _in_order(df: DataFrame, order: list[str], name: str, n: int) -> DataFrame:
    """``df`` by ``order``, nulls first, with ``_part`` and ``_at``, the place in that part; written, so that a retried task sees the same places."""
    # Equal rows are told apart by where they were read, so that many of them are spread too.
    tie = fresh(df.columns, "_tie")
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    # The id holds the partition above bit 33 and the row's number in it below.
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), name)


def _before(counts: DataFrame) -> DataFrame:
    """From one row per part (``_part``, ``_n``), the only thing that one task orders: the rows of all parts before it."""
    return counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))


def _span(nodes: DataFrame) -> DataFrame:
    """``SPAN`` levels up: rows of (g, idx, n, node, ...) with the block's top as ``node``, what is left of ``n``, and the ``path`` there."""
    digits = [f"_b{d}" for d in range(SPAN)]
    rows = nodes.withColumns({"block": F.shiftright("idx", SPAN), "path": F.lit(None).cast("array<struct<l:string,r:string>>")}).withColumn("path", F.coalesce("path", F.array())).repartition("g", "block")
    rows = rows.withColumns({b: F.shiftright("idx", d).bitwiseAND(F.lit(1)).cast("byte") for d, b in enumerate(digits)})
    for level, b in enumerate(digits):
        # A parent is named by the digits above, and its frame ordered by those below: one sort serves all levels.
        parent = Window.partitionBy("g", "block", *digits[:level:-1]).orderBy(*digits[level::-1]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.lit(True)
        for below in digits[:level]:
            first = first & (F.col(below) == 0)
        rows = rows.withColumn("_nodes", F.collect_list(F.when(first, F.col("node"))).over(parent))
        more, right_one = F.col("n") > 1, F.col(b) == 1
        step = F.struct(F.when(right_one, F.get("_nodes", F.lit(0))).otherwise("").alias("l"), F.when(right_one, "").otherwise(F.coalesce(F.get("_nodes", F.lit(1)), F.lit(""))).alias("r"))
        rows = rows.withColumns(
            {
                "path": F.when(more, F.concat("path", F.array(step))).otherwise(F.col("path")),
                "node": F.when(more, digest(F.array_join("_nodes", ""))).otherwise(F.col("node")),
                "n": F.shiftright(F.col("n") + 1, 1),
            }
        ).drop("_nodes")
    return rows.drop(*digits)


def _tops(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """``nodes`` and, each a 2 ** SPAN-th of the one before, the tables of block tops, down to one row a group. ``most``: the largest group."""
    tables = [nodes]
    while most > 1:
        first = F.col("idx").bitwiseAND(F.lit((1 << SPAN) - 1)) == 0
        tables.append(written(_span(tables[-1]).where(first).select("g", F.col("block").alias("idx"), "n", "node"), f"{name}-{len(tables)}"))
        most = -(-most // (1 << SPAN))
    return tables


def _down(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first table with what ``above`` (g, idx, path, ...) knows of their group and the whole path."""
    for t in reversed(tables[:-1]):
        high = above.select("g", F.col("idx").alias("block"), F.col("path").alias("_above"), *[c for c in above.columns if c not in ("g", "idx", "path")])
        above = _span(t).drop("n", "node").join(high, ["g", "block"]).withColumn("path", F.concat("path", "_above")).drop("block", "_above")
    return above


def manifest(documents: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: ``order``'s column, leaf, subroot, root, path (siblings l and r of each level, leaf to root), and ``carry``, expressions over ``fields`` found where the leaf is."""
    carry = carry or {}
    spark = documents.sparkSession
    leaves = documents.select(F.col(group).alias("_group"), F.col(order).alias("_order"), digest(*[framed(F.col(c)) for c in fields]).alias("leaf"), *[c.alias(f"_carry_{k}") for k, c in carry.items()])
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _in_order(leaves, ["_group", "_order", "leaf"], "merkle-leaves", max(shuffles, -(-documents.count() // PER_PARTITION)))
    # Where each group lies: a row per part and group, of which there are hardly more than parts and groups.
    stretches = written(placed.groupBy("_part", "_group").agg(F.count("*").alias("_n"), F.min("_at").alias("_lo")), "merkle-stretches")
    spots = stretches.join(_before(stretches.groupBy("_part").agg(F.sum("_n").alias("_n"))), "_part")
    groups = written(spots.groupBy("_group").agg(F.min(F.col("_base") + F.col("_lo")).alias("g"), F.sum("_n").alias("n")), "merkle-groups")
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    # A group's first place names it, in the order of groups.
    named = groups.withColumnRenamed("_group", "_of")
    places = written(spots.join(named, F.col("_group").eqNullSafe(F.col("_of"))).select("_part", F.col("_group").alias("_of"), (F.col("_base") - F.col("g")).alias("_shift"), "g", "n"), "merkle-places")
    near = places.withColumnRenamed("_part", "_of_part")
    nodes = placed.join(near, (F.col("_part") == F.col("_of_part")) & F.col("_group").eqNullSafe(F.col("_of"))).select(
        "g", (F.col("_at") + F.col("_shift")).alias("idx"), "n", F.col("leaf").alias("node"), F.col("_order").alias(order), "leaf", *[f"_carry_{k}" for k in carry]
    )
    tables = _tops(nodes, most or 0, "merkle-level")
    tops = tables[-1].select("g", F.col("node").alias("subroot"))
    # The groups' tops are the leaves of one more tree, of one group.
    listed = _in_order(groups.select(F.col("g").alias("of")), ["of"], "merkle-order", shuffles)
    ranks = listed.join(_before(listed.groupBy("_part").agg(F.count("*").alias("_n"))), "_part").select("of", (F.col("_base") + F.col("_at")).alias("idx"))
    roots = written(ranks.join(tops, ranks["of"] == tops["g"]).select(F.lit(0).cast("long").alias("g"), "idx", F.lit(count).cast("long").alias("n"), F.col("subroot").alias("node"), "of", "subroot"), "merkle-subroots")
    over = _tops(roots, count, "merkle-root")
    root = over[-1].select("g", F.col("node").alias("root"))
    if len(over) == 1:
        whole = over[0].withColumns({"root": F.col("node"), "path": F.array().cast("array<struct<l:string,r:string>>")})
    else:
        whole = _down(over, root.withColumns({"idx": F.lit(0).cast("long"), "path": F.array().cast("array<struct<l:string,r:string>>")}))
    known = written(whole.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "path", "subroot", "root"), "merkle-known")
    out = _down(tables, known) if len(tables) > 1 else nodes.join(known.drop("idx"), "g")
    spent(stretches, groups, listed, roots, *over[1:])
    return out.select(order, "leaf", "subroot", "root", "path", *[F.col(f"_carry_{k}").alias(k) for k in carry])
