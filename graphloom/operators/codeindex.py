"""Joins over code facts: references, method sets, nested intervals, division, tags, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import settle

# syntax trees as rows (file, pre, post, kind, parent, edge, idx): a node's subtree is pre..post


def of_kinds(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Preorder scan of some kinds of node."""
    return (nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes).orderBy("file", "pre")


def subtree(nodes: DataFrame, file, pre: int, post: int) -> DataFrame:
    return nodes.where((F.col("file") == file) & F.col("pre").between(pre, post))


def enclosing(nodes: DataFrame, file, pre: int, post: int) -> DataFrame:
    """A node and its ancestors, innermost first."""
    return nodes.where((F.col("file") == file) & (F.col("pre") <= pre) & (F.col("post") >= post)).orderBy(F.desc("pre"))


def contains(outer_pre: Column, outer_post: Column, pre: Column, post: Column) -> Column:
    return (outer_pre <= pre) & (outer_post >= post)


def prune(nodes: DataFrame, stops: DataFrame) -> DataFrame:
    """Nodes that lie in no subtree of ``stops (file, pre, post)``, the stops themselves kept.

    A running maximum of the stops' ends replaces an interval join.
    """
    tagged = nodes.join(stops.select("file", "pre", F.lit(True).alias("__stop")), ["file", "pre"], "left")
    before = Window.partitionBy("file").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("__stop"), F.col("post"))).over(before)
    return tagged.withColumn("__end", last).where("__end IS NULL OR __end < pre").drop("__end", "__stop")


def siblings(nodes: DataFrame) -> DataFrame:
    """Adds next_sibling, prev_sibling, is_first and is_last among the children of one parent."""
    w = Window.partitionBy("file", "parent").orderBy("pre")
    return nodes.withColumns({"next_sibling": F.lead("pre").over(w), "prev_sibling": F.lag("pre").over(w), "is_first": F.lag("pre").over(w).isNull(), "is_last": F.lead("pre").over(w).isNull()})


def children(nodes: DataFrame, file, parent: int, edge: str | None = None, idx: int | None = None) -> DataFrame:
    out = nodes.where((F.col("file") == file) & (F.col("parent") == parent))
    out = out.where(F.col("edge") == edge) if edge is not None else out
    out = out.where(F.col("idx") == idx) if idx is not None else out
    return out.orderBy("pre")


def innermost(points: DataFrame, spans: DataFrame, group: list[str], bucket: int = 1 << 12) -> DataFrame:
    """Each point ``(group.., at)`` with the narrowest of ``spans (group.., lo, hi, span)`` that encloses it.

    Spans are listed under every bucket of positions they touch, so the join is
    an equi-join on group and bucket; ties go to the earlier span.
    """
    b = F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("__b")
    listed = spans.select(*group, "lo", "hi", "span", b)
    placed = points.withColumn("__b", F.floor(F.col("at") / bucket))
    found = placed.join(listed, [*group, "__b"]).where("at BETWEEN lo AND hi")
    pick = F.min_by(F.struct("span", "lo", "hi"), F.struct(F.col("hi") - F.col("lo"), F.col("lo"), F.col("span")))
    return found.groupBy(*points.columns).agg(pick.alias("__p")).select(*points.columns, "__p.span", "__p.lo", "__p.hi")


# indexes


def postings(uses: DataFrame, obj: str, pos: str) -> DataFrame:
    """obj -> sorted positions."""
    return uses.groupBy(obj).agg(F.array_sort(F.collect_list(pos)).alias("positions"))


def lookup_refs(index: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """References of an index ``(keys.., refs array)`` to any target, one row each."""
    return index.join(targets.select(keys).distinct(), keys, "left_semi").select(*keys, F.explode("refs").alias("ref"))


def provide_all(entries: DataFrame, by: str, item: str, wanted: list[str]) -> DataFrame:
    """Relational division: values of ``by`` that have every wanted item."""
    names = sorted(set(wanted))
    held = entries.where(F.col(item).isin(names)).groupBy(by).agg(F.count_distinct(item).alias("__n"))
    return held.where(F.col("__n") == len(names)).select(by)


def lookup(entries: DataFrame, package: str, name: str, is_prefix: bool = False) -> DataFrame:
    test = F.startswith("name", F.lit(name)) if is_prefix else F.col("name") == name
    return entries.where((F.col("pkg_name") == package) & test)


def with_mask(types: DataFrame) -> DataFrame:
    """Adds ``mask``, bits of the hashes of a ``methods`` array: a subset of methods has a subset of bits."""
    bits = F.aggregate("methods", F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.crc32(m.cast("binary")) % 64).cast("int"))))
    return types.withColumn("mask", bits)


def method_sets(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, set): every key by the number of its method sets; (set, methods): the sets of every number.

    Keys of equal sets share a number, so what is asked of sets is asked once.
    """
    whole = rows.where("size(methods) > 0").select(key, F.array_sort(F.array_distinct("methods")).alias("methods"))
    each = settle(whole.groupBy(key).agg(F.array_sort(F.collect_set("methods")).alias("sets")))
    numbered = settle(each.select("sets").distinct().withColumn("set", F.monotonically_increasing_id()))
    return settle(each.join(numbered, "sets").select(key, "set")), with_mask(numbered.select("set", F.explode("sets").alias("methods")))


#: Parts that the types of one set of methods are spread over: a frequent set would be one task.
PARTS = 16


def implements(concrete: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(type, interface): ``concrete (type, methods)`` has every method of ``interfaces (interface, methods)``.

    Different method sets are compared, not types and interfaces: joined on one
    method of each wanted set, its rarest, so candidates are few; the bit mask
    then the arrays decide.  A type and an interface have one number each, so
    pairs come out once and are not shuffled.  Empty interfaces match nothing.
    """
    types, have = method_sets(concrete, "type")
    wanted, want = method_sets(interfaces, "interface")
    have = have.withColumnsRenamed({"set": "s1", "methods": "m1", "mask": "mask1"})
    want = want.withColumnsRenamed({"set": "s2", "methods": "m2", "mask": "mask2"})
    each = have.withColumn("method", F.explode("m1"))
    often = each.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    rare = want.select("s2", "m2", F.explode("m2").alias("method")).join(often, "method", "left").groupBy("s2", "m2").agg(F.min_by("method", F.struct(F.coalesce("n", F.lit(0)), "method")).alias("method"))
    probe = want.join(rare, ["s2", "m2"])
    held = each.join(probe, "method").where("mask1 & mask2 = mask2").where(F.size(F.array_except("m2", "m1")) == 0).select("s1", "s2").distinct()
    typed = held.join(types.withColumnRenamed("set", "s1"), "s1").select("type", "s2", F.pmod(F.xxhash64("type"), F.lit(PARTS)).alias("part"))
    spread = wanted.select("interface", F.col("set").alias("s2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    return typed.join(spread, ["s2", "part"]).select("type", "interface")


def equivalence_classes(refs: DataFrame, decl: str, ref: str) -> DataFrame:
    """Declarations that reach the same set: (decls, refs), classes by their first declaration."""
    sets = refs.groupBy(decl).agg(F.array_sort(F.collect_set(ref)).alias("refs"))
    return sets.groupBy("refs").agg(F.array_sort(F.collect_list(decl)).alias("decls")).select("decls", "refs")


def related(items: DataFrame, item: str, tag: str) -> DataFrame:
    """(a, b, shared): items that share tags, and how many, each pair both ways."""
    t = items.select(item, tag).distinct()
    pairs = t.withColumnRenamed(item, "a").join(t.withColumnRenamed(item, "b"), tag).where("a != b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def newer_older(items: DataFrame, group: list[str], item: str, time: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(time), F.desc(item))
    return items.select(*group, item, F.lag(item).over(w).alias("newer"), F.lead(item).over(w).alias("older"))


def findings(modules: DataFrame, advisories: DataFrame, imported: DataFrame) -> DataFrame:
    """(id, module, package): advisories on a used module whose affected package is imported.

    ``advisories (id, affected array<struct<module, packages array<string>>>)``.
    """
    flat = advisories.select("id", F.explode("affected").alias("a")).select("id", F.col("a.module").alias("module"), F.explode("a.packages").alias("package"))
    return flat.join(modules.select("module").distinct(), "module", "left_semi").join(imported.select("package").distinct(), "package", "left_semi").select("id", "module", "package").distinct()


def first_by_priority(rows: DataFrame, key: str, priority: Column) -> DataFrame:
    """One row per key, the first by priority."""
    w = Window.partitionBy(key).orderBy(priority)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def callers(refs: DataFrame, functions: DataFrame, group: list[str]) -> DataFrame:
    """References ``(group.., at, target)`` by innermost enclosing function: (target, caller, sites)."""
    inside = innermost(refs, functions, group)
    return inside.groupBy("target", F.col("span").alias("caller")).agg(F.array_sort(F.collect_list("at")).alias("sites"))


def interval_conflicts(edits: DataFrame, group: list[str]) -> DataFrame:
    """Edits ``(group.., start, end)`` that begin before an earlier one ends."""
    w = Window.partitionBy(*group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("__before", F.max("end").over(w)).where(F.col("__before") > F.col("start")).drop("__before")
