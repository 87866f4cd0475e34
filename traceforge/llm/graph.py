"""Connected components of an edge table, by shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import spent, view, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); a component is named by its least node.

    Each round every node takes the least name among its own and its neighbours', then follows the
    name to that node's name (pointer jumping), so a chain halves each round. A round's table is
    written to the shared folder, the one before deleted. The aggregate combines before its shuffle, and a
    node with very many neighbours is split by Spark's skew join: names stand on one side, once per node.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "names")
    while True:
        names = last.select("node", "component")
        of = names.select(F.col("node").alias("b"), F.col("component").alias("near"))
        offers = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        taken = names.join(offers, "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = names.select(F.col("node").alias("to"), F.col("component").alias("then"))
        after = written(taken.join(jump, "to").select("node", F.least("to", "then").alias("component"), (F.least("to", "then") != F.col("component")).alias("moved")), "names")
        spent(last)
        last = after
        if after.where("moved").isEmpty():
            spent(both)
            return view(after, after.select("node", "component"))
