"""Connected components over an edge table, by hooking to the least neighbour.

Every round each node hooks to its least neighbour, pointers are doubled until
they reach the roots, and the edges are contracted to edges between roots.
Everything stays in distributed tables; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SALTS = 8


def _through(left: DataFrame, col: str, pointers: DataFrame, spread: str) -> DataFrame:
    """Replace ``col`` by what ``pointers (node, parent)`` gives for it, hot values split over salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    p = pointers.select(F.col("node").alias(col), F.col("parent").alias("__to"), salts)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(p, [col, "__salt"], "left").withColumn(col, F.coalesce("__to", col)).drop("__to", "__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges (a, b)``; root is the least node of its component."""
    both = edges.where("a != b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = None
    while not both.isEmpty():
        pointers = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")))
        while True:
            jumped = materialise(
                _through(pointers.select("node", F.col("parent").alias("old"), "parent"), "parent", pointers, "node").select("node", "old", "parent")
            )
            pointers = jumped.select("node", "parent")
            if jumped.where("old != parent").isEmpty():
                break
        roots = pointers.select("node", F.col("parent").alias("root")) if roots is None else materialise(_through(roots, "root", pointers, "node"))
        moved = _through(_through(both, "a", pointers, "b"), "b", pointers, "a")
        both = materialise(moved.where("a != b").distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return roots.select("node", "root")
