"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour; after a number of rounds that grows
with the logarithm of the longest chain every node points at the smallest node of its component.
Neighbours are only ever reduced by min(), never collected, and a node that holds more than one in
``SHARE`` of all rows gets its smallest neighbour by broadcast instead of by shuffle, so no task has
to take all rows of a hub. Nothing but two totals a round reaches the driver. Nodes may be of any
type that can be ordered; edges with a null node link nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import removed, written

SHARE = 1000  # a key with more than one in so many rows is hot; there can't be more hot keys than that


def join_unique(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key; ``counts`` (key, n) tells how many rows each key has.

    Hot keys, at most ``SHARE``, are broadcast; the rest is joined by shuffle.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * SHARE > total).select(key))
    return rows.join(F.broadcast(table.join(hot, key)), key).unionByName(rows.join(hot, key, "left_anti").join(table, key))


def _star(pairs: DataFrame, larger: bool) -> tuple[DataFrame, list[str]]:
    """One step: each node's chosen neighbours are linked to the smallest of the node and its neighbours. Also the folders it has written."""
    least, at = written(pairs.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n"))
    joined = join_unique(pairs, least.select("a", "low"), "a", least.select("a", "n"))
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    kept, path = written(out.where("a <> b").distinct())
    return kept, [at, path]


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that isn't its component's smallest; root is the smallest. Repeated edges and edges from a node to itself change nothing; no edges give no rows."""
    spark = edges.sparkSession
    edges, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _sign(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large, used = _star(both, True)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges, again = _star(down, False)
        for old in (path, *used, again[0]):
            removed(spark, old)
        path = again[1]
        after = _sign(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
