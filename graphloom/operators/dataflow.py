"""Monotone dataflow over edge tables, with sets of facts as rows or lattice values as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import grow, settle


def forward(nodes: DataFrame, edges: DataFrame, entry: DataFrame | None, transfer: Callable[[Column, Column, Column], Column], merge: Callable[[Column], Column], identity) -> DataFrame:
    """(id, fact): merge of the predecessors' edge facts at every node, iterated until stable.

    ``entry (id, fact)`` applies to nodes without predecessors only.  ``merge``
    is an aggregate (max, bit_or, ...), ``transfer`` an expression over source,
    destination and the source's fact.
    """
    out = settle(edges.select("src", "dst").distinct())
    heads = nodes.select("id").distinct().join(out.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    given = heads.join(entry, "id", "left") if entry is not None else heads.withColumn("fact", F.lit(None))
    fixed = given.select("id", F.coalesce("fact", identity).alias("fact"))
    facts = settle(nodes.select("id").distinct().join(heads, "id", "left_anti").select("id", identity.alias("fact")).unionByName(fixed))
    fixed = settle(fixed)
    while True:
        sent = out.join(facts, out["src"] == facts["id"]).select(F.col("dst").alias("id"), transfer(F.col("src"), F.col("dst"), F.col("fact")).alias("fact"))
        merged = settle(sent.groupBy("id").agg(merge(F.col("fact")).alias("fact")).unionByName(fixed))
        moved = not merged.exceptAll(facts).isEmpty()
        facts = merged
        if not moved:
            return facts


def edge_facts(edges: DataFrame, facts: DataFrame, transfer: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(src, dst, fact): what each edge carries once the facts are stable."""
    return edges.join(facts, edges["src"] == facts["id"]).select("src", "dst", transfer(F.col("src"), F.col("dst"), F.col("fact")).alias("fact"))


def propagate(edges: DataFrame, initial: DataFrame) -> DataFrame:
    """(id, type): union of initial types pushed along the edges, as rows, until no pair is new."""
    out = settle(edges.select("src", "dst").distinct())

    def step(newest: DataFrame, _: int) -> DataFrame:
        return newest.join(out, newest["id"] == out["src"]).select(F.col("dst").alias("id"), "type").distinct()

    return grow(initial.select("id", "type").distinct(), step, ["id", "type"])


def dominators(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(id, dominator) for nodes reachable from one root, every node dominating itself.

    A dominator lies on every path, so on the breadth-first tree path too: the
    candidates are tree ancestors, and one falls when some predecessor of the
    node lacks it.  No pair of unrelated nodes is ever formed.  All pairs are
    checked once; after that only what fell in the last round can bring down more.
    """
    from .graph import levels

    depth = settle(levels(edges, root))
    known = depth.withColumnRenamed("id", "src").select("src", F.col("depth").alias("d1"))
    out = edges.select("src", "dst").where("src != dst").distinct().join(known, "src")
    out = settle(out.join(depth.withColumnRenamed("id", "dst"), "dst").where("depth > 0").select("src", "dst", "d1", "depth"))
    parent = settle(out.where("d1 = depth - 1").groupBy("dst", "depth").agg(F.min("src").alias("parent")))
    layer, level = settle(depth.where("depth = 0").select("id", F.array("id").alias("path"))), 0
    paths = layer
    while not layer.isEmpty():  # a node's tree path is its parent's and itself: every node is seen once
        level += 1
        below = parent.where(F.col("depth") == level).select("dst", "parent")
        layer = settle(layer.join(below, layer["id"] == below["parent"]).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path")))
        paths = settle(paths.unionByName(layer)) if level % 32 == 0 else paths.unionByName(layer)
    held = settle(paths.select("id", F.explode("path").alias("dominator")))
    preds = out.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    agreed = out.join(held, out["src"] == held["id"]).groupBy(F.col("dst").alias("id"), "dominator").agg(F.count(F.lit(1)).alias("agree"))
    checked = held.where("id != dominator").join(preds.withColumnRenamed("dst", "id"), "id").join(agreed, ["id", "dominator"], "left")
    fallen = checked.where("agree IS NULL OR agree < n").select("id", "dominator")

    def follow(newest: DataFrame, _: int) -> DataFrame:
        hit = newest.join(out, newest["id"] == out["src"]).where("dst != dominator").select(F.col("dst").alias("id"), "dominator").distinct()
        return hit.join(held, ["id", "dominator"], "left_semi")

    return held.join(grow(fallen, follow, ["id", "dominator"]), ["id", "dominator"], "left_anti")


def immediate_dominators(dom: DataFrame) -> DataFrame:
    """(id, idom): of the strict dominators the one with most dominators itself."""
    depth = dom.groupBy("id").agg(F.count(F.lit(1)).alias("depth"))
    strict = dom.where("id != dominator").join(depth.withColumnRenamed("id", "dominator"), "dominator")
    return strict.groupBy("id").agg(F.max_by("dominator", "depth").alias("idom"))


def dominance_frontier(edges: DataFrame, dom: DataFrame) -> DataFrame:
    """(id, frontier): nodes that some node dominated by ``id`` leads to and ``id`` does not strictly dominate."""
    led = dom.alias("d").join(edges.alias("e"), F.col("d.id") == F.col("e.src")).select(F.col("d.dominator").alias("id"), F.col("e.dst").alias("frontier")).distinct()
    strict = dom.where("id != dominator").select(F.col("dominator").alias("id"), F.col("id").alias("frontier"))
    return led.join(strict, ["id", "frontier"], "left_anti")


def rapid_types(roots: DataFrame, static: DataFrame, creates: DataFrame, invokes: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reachable functions and live types, grown together until neither changes.

    ``static (src, dst)`` calls, ``creates (func, type)``, ``invokes (func,
    name)`` dynamic calls by method name, ``methods (type, name, func)``.
    """
    funcs = settle(roots.select(F.col("id").alias("func")).distinct())
    types = settle(creates.join(funcs, "func", "left_semi").select("type").distinct())
    size = (-1, -1)
    while True:
        called = static.join(funcs.withColumnRenamed("func", "src"), "src", "left_semi").select(F.col("dst").alias("func"))
        names = invokes.join(funcs, "func", "left_semi").select("name").distinct()
        bound = methods.join(types, "type", "left_semi").join(names, "name", "left_semi").select("func")
        funcs = settle(funcs.unionByName(called).unionByName(bound).distinct())
        types = settle(types.unionByName(creates.join(funcs, "func", "left_semi").select("type")).distinct())
        now = (funcs.count(), types.count())
        if now == size:
            return funcs, types
        size = now
