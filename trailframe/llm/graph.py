"""Connected components of links that may join any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node reachable) of every node of edges(a, b).

    Rounds of: each node points at its smallest neighbour, pointers are followed
    to their ends by doubling, and the links are contracted to the ends.  The
    number of rounds goes with the logarithm of the nodes.  Minima are partial
    aggregates, and each round is cut off by a table in the shared folder.
    Links with a null end or of a node to itself join nothing; without links there is no row.
    """
    both = edges.select("a", "b").where("a <> b")
    links = scratch.written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        ends = links.union(links.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        roots = followed(scratch.written(ends.select("node", F.least("node", "least").alias("root")), "pointers"), scratch)
        moved = roots.where("node <> root").select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if found is None:
            found = roots
        else:
            new = found.join(moved, found.root == moved._n, "left")
            found = scratch.written(new.select("node", F.coalesce("_r", "root").alias("root")), "roots")
        for side in ("a", "b"):
            links = links.join(moved, links[side] == moved._n, "left").withColumn(side, F.coalesce("_r", side)).drop("_n", "_r")
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = scratch.written(links.distinct(), "links")
    return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def followed(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointers of a forest, each to the root of its tree."""
    while True:
        ends = pointers.where("node <> root").select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        longer = pointers.join(ends, pointers.root == ends._n, "left")
        if longer.where("_n is not null").isEmpty():
            return pointers
        pointers = scratch.written(longer.select("node", F.coalesce("_r", "root").alias("root")), "pointers")
