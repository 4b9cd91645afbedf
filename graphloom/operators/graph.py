"""Directed-graph queries over ``edges (src, dst)`` and, where isolated nodes matter, ``nodes (id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import grow, settle


def nodes_of(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """All nodes: both ends of every edge, and isolated ones given apart."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ends.unionByName(isolated.select("id")) if isolated is not None else ends).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree; isolated nodes have zeros.  One shuffle for both counts."""
    halves = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("h")).select("h.*")
    every = halves.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def successors(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Direct successors of any of the nodes ``of (id)``."""
    return edges.join(of.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def predecessors(edges: DataFrame, of: DataFrame) -> DataFrame:
    return successors(transpose(edges), of)


def levels(edges: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, depth): breadth-first distance from the nearest root; roots not in the graph stay, at 0."""
    out = settle(edges.select("src", "dst").distinct())

    def step(newest: DataFrame, depth: int) -> DataFrame:
        return newest.join(out, newest["id"] == out["src"]).select(F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(depth))

    return grow(roots.select("id").distinct().withColumn("depth", F.lit(0)), step, ["id"], limit)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Reflexive transitive closure from the roots."""
    return levels(edges, roots).select("id")


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return reachable(transpose(edges), targets)


def all_paths(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """Edges on any walk from ``start`` to ``end``; none if there is no walk."""
    on = settle(reachable(edges, start).intersect(reaching(edges, end)))
    inner = edges.select("src", "dst").distinct().join(on.withColumnRenamed("id", "src"), "src", "left_semi")
    return inner.join(on.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def focus(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Edges on paths through a node: out of what it reaches, or into what reaches it."""
    ahead, behind = reachable(edges, node), reaching(edges, node)
    down = edges.join(ahead.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst")
    up = edges.join(behind.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    return down.unionByName(up).distinct()


def shortest_path(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """(step, id) of one shortest path, ties by the least predecessor; empty if none, one row if start is end."""
    depth = settle(levels(edges, start))
    back = depth.alias("d").join(edges.alias("e"), F.col("d.id") == F.col("e.dst")).join(depth.alias("p"), F.col("e.src") == F.col("p.id"))
    parents = settle(back.where("p.depth = d.depth - 1").groupBy(F.col("d.id").alias("id")).agg(F.min("p.id").alias("parent")))
    here = settle(depth.join(end.select("id"), "id", "left_semi").orderBy("depth", "id").limit(1))
    path = here
    while not here.where("depth > 0").isEmpty():
        here = settle(here.join(parents, "id").select(F.col("parent").alias("id"), (F.col("depth") - 1).alias("depth")))
        path = path.unionByName(here)
    return path.select(F.col("depth").alias("step"), "id")


def path_to_any(edges: DataFrame, start: DataFrame, is_end) -> DataFrame:
    """Shortest path from a start node to the nearest node that satisfies a predicate column over ``id``."""
    ends = nodes_of(edges, start).where(is_end)
    return shortest_path(edges, start, ends)


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): least node of the strongly connected component of every node.

    Nodes without edges in or out of what is left are trimmed as components of
    their own; the rest is coloured by the least node that reaches it, and the
    nodes of a colour that reach its root are that root's component.  Repeats
    on what is left; each round settles at least one component per colour.
    """
    done = None
    left = settle(edges.where("src != dst").select("src", "dst").distinct())
    while not left.isEmpty():
        while True:  # trim
            sources, sinks = left.select(F.col("src").alias("id")).distinct(), left.select(F.col("dst").alias("id")).distinct()
            inner = settle(sources.intersect(sinks))
            cut = settle(left.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
            same = cut.count() == left.count()
            left = cut
            if same or left.isEmpty():
                break
        if left.isEmpty():
            break
        colour = settle(nodes_of(left).withColumn("colour", F.col("id")))
        while True:
            pushed = left.join(colour, left["src"] == colour["id"]).select(F.col("dst").alias("id"), "colour")
            lower = settle(colour.unionByName(pushed).groupBy("id").agg(F.min("colour").alias("colour")))
            moved = not lower.join(colour, ["id", "colour"], "left_anti").isEmpty()
            colour = lower
            if not moved:
                break
        ends = left.join(colour.withColumnsRenamed({"id": "src", "colour": "c1"}), "src").join(colour.withColumnsRenamed({"id": "dst", "colour": "c2"}), "dst")
        within = settle(ends.where("c1 = c2").select("src", "dst", F.col("c1").alias("colour")))
        roots = colour.where("id = colour")

        def step(newest: DataFrame, _: int) -> DataFrame:
            return newest.join(within, (newest["id"] == within["dst"]) & (newest["colour"] == within["colour"])).select(F.col("src").alias("id"), newest["colour"]).distinct()

        found = settle(grow(roots, step, ["id", "colour"]).withColumnRenamed("colour", "component"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        left = settle(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    every = nodes.select("id").distinct()
    if done is None:
        return every.withColumn("component", F.col("id"))
    return every.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def nontrivial_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of more than one node, or of one with an edge to itself."""
    comp = settle(strong_components(nodes, edges))
    own = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    sized = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return comp.join(sized, "component").join(own, "id", "left").where("size > 1 OR loop").select("id", "component", "size")


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between different components."""
    c1 = components.select(F.col("id").alias("src"), F.col("component").alias("c1"))
    c2 = components.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    return edges.join(c1, "src").join(c2, "dst").where("c1 != c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst")).distinct()


def break_cycles(edges: DataFrame, components: DataFrame, updated: DataFrame) -> DataFrame:
    """Edges without those inside a component that leave an updated node."""
    c1 = components.select(F.col("id").alias("src"), F.col("component").alias("c1"))
    c2 = components.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    inner = edges.join(c1, "src").join(c2, "dst").where("c1 = c2").join(updated.select(F.col("id").alias("src")), "src", "left_semi")
    return edges.join(inner.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): longest path from a source in an acyclic graph; dependencies come first by level."""
    left = settle(edges.select("src", "dst").distinct())
    rest = settle(nodes.select("id").distinct())
    out, level = None, 0
    while not rest.isEmpty():
        ready = settle(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        marked = ready.withColumn("level", F.lit(level))
        out = marked if out is None else out.unionByName(marked)
        rest = settle(rest.join(ready, "id", "left_anti"))
        left = settle(left.join(ready.withColumnRenamed("id", "src"), "src", "left_anti"))
        level += 1
    return out if out is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def compact(nodes: DataFrame) -> DataFrame:
    """(idx, id): dense numbers from 0 in id order, without one task that sees all rows.

    Rows are range-partitioned by id; a partition numbers its own rows from the
    count of the partitions before it, of which there are few.
    """
    ranged = nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("__part", F.spark_partition_id())
    ranged = settle(ranged)
    sizes = ranged.groupBy("__part").count().orderBy("__part").collect()  # a row for each partition
    base, starts = 0, {}
    for r in sizes:
        starts[r["__part"]] = base
        base += r["count"]
    offsets = ranged.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "__part int, __base long")
    local = F.row_number().over(Window.partitionBy("__part").orderBy("id"))
    return ranged.join(F.broadcast(offsets), "__part").select((F.col("__base") + local - 1).alias("idx"), "id")


def bypass(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Delete flagged nodes one after another, joining what led in with what led out; no duplicate edges."""
    out = edges.select("src", "dst").distinct()
    gone = settle(removed.select("id").distinct())
    # paths through removed nodes only: from a kept node into, within, and out to a kept node
    into = settle(out.join(gone, out["dst"] == gone["id"], "left_semi").join(gone, out["src"] == gone["id"], "left_anti"))
    within = settle(out.join(gone, out["src"] == gone["id"], "left_semi"))

    def step(newest: DataFrame, _: int) -> DataFrame:
        inner = newest.join(gone, newest["dst"] == gone["id"], "left_semi")
        return inner.alias("a").join(within.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", F.col("b.dst").alias("dst")).distinct()

    new = grow(into, step, ["src", "dst"]).join(gone, F.col("dst") == gone["id"], "left_anti")
    kept = out.join(gone, out["src"] == gone["id"], "left_anti").join(gone, out["dst"] == gone["id"], "left_anti")
    return kept.unionByName(new).distinct()


def delete_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without any end among the removed nodes."""
    return edges.join(removed.select(F.col("id").alias("src")), "src", "left_anti").join(removed.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def reverse_dependencies(edges: DataFrame, of: DataFrame, transitive: bool = True) -> DataFrame:
    """What depends on the nodes, themselves excluded."""
    found = reaching(edges, of) if transitive else predecessors(edges, of)
    return found.join(of.select("id"), "id", "left_anti")
