"""Every query of the library over the driver's tables, with its SQL.

The tables hold no code, so each query states which rows stand for its input:
suppliers and customers refer to each other by fixed arithmetic (a cyclic
graph), regions, nations, customers and suppliers form a tree, order lines
stand for benchmark and coverage rows, events for metrics.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render, text
from ..operators import bloom, codeindex, compare, coverage, dataflow, graph, metrics, ordering, search, sequences, sets
from ..streaming import metrics as streams
from .fixpoint import ensure_checkpoint_dir, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def T(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- graphs


def refs(s: SparkSession, d: str, table: str) -> DataFrame:
    """Each customer (supplier) refers to two others, by its key and nation."""
    k, nat = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}[table]
    rows = T(s, d, table).select(F.col(k).alias("k"), F.col(nat).cast("long").alias("m"))
    n = rows.count()
    to = F.explode(F.array((F.col("k") * 17 + F.col("m") * 101 + 3) % n, (F.col("k") * 61 + F.col("m") * 13 + 7) % n))
    return settle(rows.select(F.col("k").alias("src"), to.alias("dst")).distinct())


def ref_sql(table: str) -> str:
    k, nat = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}[table]
    return f"""n AS (SELECT count(*) AS n FROM {table}),
      e AS (SELECT {k} AS src, ({k} * 17 + {nat} * 101 + 3) % n AS dst FROM {table}, n UNION SELECT {k}, ({k} * 61 + {nat} * 13 + 7) % n FROM {table}, n),
      v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""


C, S = ref_sql("customer"), ref_sql("supplier")
_BFS = "b(id, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < 40)"
_FWD = "f(id) AS (SELECT {0}::BIGINT UNION SELECT e.dst FROM f JOIN e ON e.src = f.id)"
_REV = "r(id) AS (SELECT {0}::BIGINT UNION SELECT e.src FROM r JOIN e ON e.dst = r.id)"
_PAIRS = "p(a, b) AS (SELECT src, dst FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b)"
_COMP = "c AS (SELECT v.id, least(v.id, coalesce(min(q.b), v.id)) AS component FROM v LEFT JOIN (SELECT p.a, p.b FROM p JOIN p q ON p.a = q.b AND p.b = q.a) q ON q.a = v.id GROUP BY v.id)"


def one(s: SparkSession, *ids: int) -> DataFrame:
    return s.createDataFrame([(i,) for i in ids], "id long")


@query(f"WITH {C} SELECT id FROM v")
def g_nodes(s, d):
    return graph.nodes_of(refs(s, d, "customer"))


@query(f"WITH {C} SELECT v.id, (SELECT count(*) FROM e WHERE dst = v.id) AS in_degree, (SELECT count(*) FROM e WHERE src = v.id) AS out_degree FROM v")
def g_degree(s, d):
    e = refs(s, d, "customer")
    return graph.degree(graph.nodes_of(e), e)


@query(f"WITH {C} SELECT dst AS src, src AS dst FROM e")
def g_transpose(s, d):
    return graph.transpose(refs(s, d, "customer"))


@query(f"WITH {C} SELECT DISTINCT dst AS id FROM e WHERE src IN (0, 7)")
def g_successors(s, d):
    return graph.successors(refs(s, d, "customer"), one(s, 0, 7))


@query(f"WITH {C} SELECT DISTINCT src AS id FROM e WHERE dst IN (0, 7, 10)")
def g_predecessors(s, d):
    return graph.predecessors(refs(s, d, "customer"), one(s, 0, 7, 10))


@query(f"WITH RECURSIVE {C}, {_FWD.format(0)} SELECT id FROM f")
def g_reachable(s, d):
    return graph.reachable(refs(s, d, "customer"), one(s, 0))


@query(f"WITH RECURSIVE {C}, {_REV.format(0)} SELECT id FROM r")
def g_reaching(s, d):
    return graph.reaching(refs(s, d, "customer"), one(s, 0))


@query(f"WITH RECURSIVE {C}, {_BFS} SELECT id, min(depth) AS depth FROM b GROUP BY id")
def g_levels(s, d):
    return graph.levels(refs(s, d, "customer"), one(s, 0))


@query(f"WITH RECURSIVE {C}, {_BFS} SELECT (SELECT min(depth) FROM b WHERE id = 41) AS hops")
def g_shortest_path_length(s, d):
    return graph.shortest_path(refs(s, d, "customer"), one(s, 0), one(s, 41)).agg(F.max("step").alias("hops"))


@query(f"WITH RECURSIVE {C}, {_FWD.format(0)}, {_REV.format(41)}, i AS (SELECT id FROM f INTERSECT SELECT id FROM r) SELECT src, dst FROM e WHERE src IN (FROM i) AND dst IN (FROM i)")
def g_all_paths(s, d):
    return graph.all_paths(refs(s, d, "customer"), one(s, 0), one(s, 41))


@query(f"WITH RECURSIVE {C}, {_FWD.format(5)}, {_REV.format(5)} SELECT src, dst FROM e WHERE src IN (FROM f) OR dst IN (FROM r)")
def g_focus(s, d):
    return graph.focus(refs(s, d, "customer"), one(s, 5))


@query(f"WITH RECURSIVE {S}, {_PAIRS}, {_COMP} SELECT id, component FROM c")
def g_components(s, d):
    e = refs(s, d, "supplier")
    return graph.strong_components(graph.nodes_of(e), e)


@query(
    f"WITH RECURSIVE {S}, {_PAIRS}, {_COMP}, z AS (SELECT component, count(*) AS size FROM c GROUP BY 1) "
    "SELECT c.id, c.component, z.size FROM c JOIN z USING (component) WHERE z.size > 1 OR c.id IN (SELECT src FROM e WHERE src = dst)"
)
def g_nontrivial_components(s, d):
    e = refs(s, d, "supplier")
    return graph.nontrivial_components(graph.nodes_of(e), e)


@query(f"WITH RECURSIVE {S}, {_PAIRS}, {_COMP} SELECT DISTINCT x.component AS src, y.component AS dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst WHERE x.component != y.component")
def g_condensation(s, d):
    e = refs(s, d, "supplier")
    return graph.condense(e, settle(graph.strong_components(graph.nodes_of(e), e)))


@query(
    f"WITH RECURSIVE {S}, {_PAIRS}, {_COMP} SELECT src, dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst "
    "WHERE NOT (x.component = y.component AND src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000))"
)
def g_cycles_broken(s, d):
    e = refs(s, d, "supplier")
    updated = T(s, d, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("id"))
    return graph.break_cycles(e, settle(graph.strong_components(graph.nodes_of(e), e)), updated)


@query(f"WITH {C} SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id FROM v")
def g_compact(s, d):
    return graph.compact(graph.nodes_of(refs(s, d, "customer")))


_GEO = """g AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
      UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def geo(s: SparkSession, d: str) -> DataFrame:
    edge = lambda t, a, x, b, y: T(s, d, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    return edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(edge("supplier", "n", "s_nationkey", "s", "s_suppkey"))


@query(f"WITH RECURSIVE {_GEO}, l(id, level) AS (SELECT DISTINCT src, 0 FROM g WHERE src NOT IN (SELECT dst FROM g) UNION SELECT g.dst, level + 1 FROM l JOIN g ON g.src = l.id) SELECT id, max(level) AS level FROM l GROUP BY id")
def g_topological_levels(s, d):
    e = settle(geo(s, d))
    return graph.topological_levels(graph.nodes_of(e), e)


_GONE = "x AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 2000)"


def gone(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("id"))


@query(
    f"WITH RECURSIVE {S}, {_GONE}, q(src, dst) AS (SELECT src, dst FROM e WHERE src NOT IN (FROM x) UNION SELECT q.src, e.dst FROM q JOIN e ON e.src = q.dst WHERE q.dst IN (FROM x)) "
    "SELECT src, dst FROM q WHERE dst NOT IN (FROM x)"
)
def g_bypassed(s, d):
    return graph.bypass(refs(s, d, "supplier"), gone(s, d))


@query(f"WITH {S}, {_GONE} SELECT src, dst FROM e WHERE src NOT IN (FROM x) AND dst NOT IN (FROM x)")
def g_nodes_deleted(s, d):
    return graph.delete_nodes(refs(s, d, "supplier"), gone(s, d))


@query(f"WITH RECURSIVE {C}, {_REV.format(3)} SELECT id FROM r WHERE id != 3")
def g_reverse_dependencies(s, d):
    return graph.reverse_dependencies(refs(s, d, "customer"), one(s, 3))


@query("SELECT o_custkey AS src, o_orderstatus AS dst, count(*) AS calls FROM orders GROUP BY 1, 2")
def g_call_multigraph(s, d):
    return T(s, d, "orders").groupBy(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst")).agg(F.count(F.lit(1)).alias("calls"))


# ---- dataflow


@query(f"WITH RECURSIVE {S}, {_PAIRS} SELECT v.id, coalesce((SELECT max(a) FROM p WHERE b = v.id), -1) AS fact FROM v")
def flow_max(s, d):
    e = refs(s, d, "supplier")
    return dataflow.forward(graph.nodes_of(e), e, None, lambda src, _, fact: F.greatest(src, fact), F.max, F.lit(-1).cast("long"))


@query(f"WITH RECURSIVE {S}, {_PAIRS} SELECT v.id, coalesce((SELECT bit_or(1::BIGINT << (a % 60)::INT) FROM p WHERE b = v.id), 0) AS fact FROM v")
def flow_bits(s, d):
    e = refs(s, d, "supplier")
    bit = lambda src: F.call_function("shiftleft", F.lit(1).cast("long"), (src % 60).cast("int"))
    return dataflow.forward(graph.nodes_of(e), e, None, lambda src, _, fact: fact.bitwiseOR(bit(src)), F.bit_or, F.lit(0).cast("long"))


@query(
    f"WITH RECURSIVE {S}, t(id, type) AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 8000 UNION SELECT e.dst, t.type FROM t JOIN e ON e.src = t.id) SELECT id, type FROM t"
)
def flow_types(s, d):
    start = T(s, d, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("type"))
    return dataflow.propagate(refs(s, d, "supplier"), start)


_DOM = f"""WITH RECURSIVE {S}, {_FWD.format(0)}, w(without, id) AS (SELECT id, 0::BIGINT FROM f WHERE id != 0 UNION SELECT w.without, e.dst FROM w JOIN e ON e.src = w.id WHERE e.dst != w.without),
      m AS (SELECT n.id, d.id AS dominator FROM f n, f d WHERE n.id = d.id OR d.id = 0 OR NOT EXISTS (SELECT 1 FROM w WHERE w.without = d.id AND w.id = n.id))"""


@query(f"{_DOM} SELECT id, dominator FROM m")
def flow_dominators(s, d):
    return dataflow.dominators(refs(s, d, "supplier"), one(s, 0))


@query(f"{_DOM}, k AS (SELECT id, count(*) AS depth FROM m GROUP BY id) SELECT m.id, arg_max(m.dominator, k.depth) AS idom FROM m JOIN k ON k.id = m.dominator WHERE m.id != m.dominator GROUP BY m.id")
def flow_immediate_dominators(s, d):
    return dataflow.immediate_dominators(settle(dataflow.dominators(refs(s, d, "supplier"), one(s, 0))))


@query(
    f"{_DOM} SELECT DISTINCT m.dominator AS id, e.dst AS frontier FROM m JOIN e ON e.src = m.id WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.id = e.dst AND y.dominator = m.dominator AND y.id != y.dominator)"
)
def flow_dominance_frontier(s, d):
    e = refs(s, d, "supplier")
    return dataflow.dominance_frontier(e, settle(dataflow.dominators(e, one(s, 0))))


@query()
def flow_rapid_types(s, d):
    """Suppliers call each other, make their nation's type, and call methods that customers stand for; no SQL: the recursion is not linear."""
    sup, cus = T(s, d, "supplier"), T(s, d, "customer")
    n = sup.count()
    creates = sup.select(F.col("s_suppkey").alias("func"), F.col("s_nationkey").alias("type"))
    invokes = sup.select(F.col("s_suppkey").alias("func"), (F.col("s_suppkey") % 7).alias("name"))
    methods = cus.select(F.col("c_nationkey").alias("type"), (F.col("c_custkey") % 7).alias("name"), (F.col("c_custkey") % n).alias("func"))
    funcs, types = dataflow.rapid_types(one(s, 0), refs(s, d, "supplier"), creates, invokes, methods)
    return funcs.select(F.lit("func").alias("kind"), F.col("func").alias("id")).unionByName(types.select(F.lit("type").alias("kind"), F.col("type").cast("long").alias("id")))


# ---- benchmark comparison: lines of a part, by status, are runs before and after


def bench_rows(s: SparkSession, d: str, status: str) -> DataFrame:
    rows = T(s, d, "lineitem").where(F.col("l_linestatus") == status).groupBy("l_partkey", "l_linenumber")
    agg = rows.agg(F.sum("l_quantity").alias("ns_per_op"), F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("alloced_bytes_per_op"), F.max("l_suppkey").alias("allocs_per_op"))
    return agg.select(F.concat(F.lit("Benchmark"), "l_partkey").alias("name"), F.col("l_linenumber").alias("ord"), "n", "ns_per_op", "alloced_bytes_per_op", "allocs_per_op", F.lit(None).cast("double").alias("mb_per_s"), F.lit(13).alias("measured"))


_BENCH = """r AS (SELECT 'Benchmark' || l_partkey AS name, l_linenumber AS ord, l_linestatus AS st, count(*) AS n, sum(l_quantity) AS ns, min(l_suppkey) AS by, max(l_suppkey) AS al
        FROM lineitem GROUP BY l_partkey, l_linenumber, l_linestatus),
      k AS (SELECT name, count(*) FILTER (st = 'O') AS n_before, count(*) FILTER (st = 'F') AS n_after FROM r GROUP BY name),
      z AS (SELECT *, row_number() OVER (PARTITION BY name, st ORDER BY ord) AS rn FROM r),
      j AS (SELECT b.name, b.ord, b.ns AS before, a.ns AS after, b.by AS by1, a.by AS by2 FROM z b JOIN z a USING (name, rn) JOIN k USING (name) WHERE b.st = 'O' AND a.st = 'F' AND n_before = n_after)"""
_RATIO = "CASE WHEN before != 0 THEN after / before WHEN after = 0 THEN 1 ELSE 'inf'::DOUBLE END AS ratio, CASE WHEN before = 0 AND after = 0 THEN 1 WHEN before = 0 OR after = 0 THEN 'inf'::DOUBLE ELSE least(before, after) / greatest(before, after) END AS mag"


def pairs(s: SparkSession, d: str) -> DataFrame:
    return compare.correlate(bench_rows(s, d, "O"), bench_rows(s, d, "F"))


@query(f"WITH {_BENCH} SELECT name, ord, before, after, {_RATIO} FROM j")
def bench_deltas(s, d):
    return compare.deltas(pairs(s, d), "ns_per_op")


@query(f"WITH {_BENCH}, h AS (SELECT name, ord, by1::DOUBLE AS before, by2::DOUBLE AS after FROM j) SELECT name, ord, before, after, {_RATIO} FROM h WHERE before != after")
def bench_changed_bytes(s, d):
    return compare.by_delta(compare.deltas(pairs(s, d), "alloced_bytes_per_op", only_changed=True))


@query(f"WITH {_BENCH} SELECT name, n_before, n_after FROM k WHERE n_before > 0 AND n_after > 0 AND n_before != n_after")
def bench_unmatched(s, d):
    return compare.unmatched(bench_rows(s, d, "O"), bench_rows(s, d, "F"))


@query(f"WITH {_BENCH} SELECT name, min(ord) AS ord, arg_min(ns, (ns, ord)) AS ns_per_op, arg_min(n, (ns, ord)) AS n FROM r WHERE st = 'O' GROUP BY name")
def bench_best(s, d):
    return compare.best(bench_rows(s, d, "O")).select("name", "ord", "ns_per_op", "n")


# ---- coverage: lines of a supplier are blocks of a file


def cover(s: SparkSession, d: str, mode: str) -> DataFrame:
    li = T(s, d, "lineitem")
    return li.select(
        F.concat(F.lit("f"), "l_suppkey").alias("file"), F.lit(mode).alias("mode"), F.col("l_linenumber").alias("start_line"), F.lit(1).alias("start_col"),
        F.col("l_linenumber").alias("end_line"), (F.col("l_partkey") % 5 + 2).cast("int").alias("end_col"), F.col("l_linenumber").alias("num_stmt"), (F.col("l_quantity").cast("long") % 8).alias("count"),
    )


_COVER = "b AS (SELECT 'f' || l_suppkey AS file, l_linenumber AS start_line, 1 AS start_col, l_linenumber AS end_line, (l_partkey % 5 + 2)::INT AS end_col, l_linenumber AS num_stmt, l_quantity::BIGINT % 8 AS c FROM lineitem)"
_POS = "file, start_line, start_col, end_line, end_col, num_stmt"


@query(f"WITH {_COVER} SELECT {_POS}, 'set' AS mode, bit_or(c) AS count FROM b GROUP BY {_POS}")
def cover_merge_set(s, d):
    return coverage.merge(cover(s, d, "set"))


@query(f"WITH {_COVER} SELECT {_POS}, 'count' AS mode, sum(c)::BIGINT AS count FROM b GROUP BY {_POS}")
def cover_merge_count(s, d):
    return coverage.merge(cover(s, d, "count"))


@query(
    f"""WITH {_COVER}, g AS (SELECT {_POS}, sum(c)::BIGINT AS count FROM b GROUP BY {_POS}), m AS (SELECT *, max(count) OVER (PARTITION BY file) AS most FROM g),
      n AS (SELECT *, CASE WHEN count <= 0 THEN 0 WHEN most <= 1 THEN 0.8 ELSE ln(count) / ln(most) END AS norm FROM m)
      SELECT file, (start_line * 100 + start_col - 1)::BIGINT AS "offset", true AS is_start, count, round(norm, 9) AS norm FROM n
      UNION ALL SELECT file, end_line * 100 + end_col - 1, false, count, 0 FROM n"""
)
def cover_boundaries(s, d):
    merged = settle(coverage.merge(cover(s, d, "count")))
    lines = merged.select("file", F.col("start_line").alias("line")).distinct().withColumn("offset", F.col("line").cast("long") * 100)
    return coverage.boundaries(merged, lines).withColumn("norm", F.round("norm", 9))


@query(f"WITH {_COVER} SELECT file, sum(CASE WHEN c > 0 THEN num_stmt ELSE 0 END)::BIGINT AS covered, sum(num_stmt)::BIGINT AS total, 100.0::DOUBLE * sum(CASE WHEN c > 0 THEN num_stmt ELSE 0 END) / sum(num_stmt) AS percent FROM b GROUP BY file")
def cover_percent(s, d):
    return coverage.percent_covered(cover(s, d, "count"))


# ---- sets and runs: parts returned (x) and parts in large open lines (y)

_XY = "x AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.02), y AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45)"


def xy(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = T(s, d, "lineitem")
    part = F.col("l_partkey").alias("v")
    return li.where("l_returnflag = 'R' AND l_discount < 0.02").select(part).distinct(), li.where("l_linestatus = 'O' AND l_quantity > 45").select(part).distinct()


@query(f"WITH {_XY} FROM x UNION FROM y")
def set_union(s, d):
    return sets.union(*xy(s, d))


@query(f"WITH {_XY} FROM x INTERSECT FROM y")
def set_intersection(s, d):
    return sets.intersection(*xy(s, d))


@query(f"WITH {_XY} FROM x EXCEPT FROM y")
def set_difference(s, d):
    return sets.difference(*xy(s, d))


@query(f"WITH {_XY} (FROM x EXCEPT FROM y) UNION (FROM y EXCEPT FROM x)")
def set_symmetric_difference(s, d):
    return sets.symmetric_difference(*xy(s, d))


@query(f"WITH {_XY} SELECT count(*) AS len, count(*) = 0 AS is_empty, min(v) AS min, max(v) AS max, min(v) FILTER (v >= 50) AS lower_bound FROM x")
def set_summary(s, d):
    return sets.summary(xy(s, d)[0], 50)


@query(
    f"""WITH {_XY} SELECT EXISTS (FROM x INTERSECT FROM y) AS intersects, NOT EXISTS (FROM x EXCEPT FROM y) AS subset, NOT EXISTS (FROM y EXCEPT FROM x) AS superset,
      NOT EXISTS (FROM x EXCEPT FROM y) AND NOT EXISTS (FROM y EXCEPT FROM x) AS equal"""
)
def set_relation(s, d):
    return sets.relation(*xy(s, d))


@query(f"WITH {_XY} SELECT '{{' || string_agg(v::VARCHAR, ' ' ORDER BY v) || '}}' AS text FROM x")
def set_text(s, d):
    return sets.text(xy(s, d)[0])


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), b AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM a)
      SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM b GROUP BY l_orderkey, k"""
)
def runs_of_lines(s, d):
    return sets.runs(T(s, d, "lineitem"), ["l_orderkey"], "l_linenumber")


# ---- metrics and spans


@query("SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY event_type")
def metric_scalar(s, d):
    return metrics.scalar(T(s, d, "events"), ["event_type"], "value").withColumn("sum", F.round("sum", 4))


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query(
    "SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, "
    + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{int(b)}" for b in BOUNDS)
    + " FROM events GROUP BY event_type"
)
def metric_histogram(s, d):
    h = metrics.histogram(T(s, d, "events"), ["event_type"], "value", BOUNDS)
    return h.select("event_type", "count", "min", "max", *[F.get("values", F.lit(i)).alias(f"le_{int(b)}") for i, b in enumerate(BOUNDS)])


_SPANS = """w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finish FROM events),
      p AS (SELECT user_id AS owner, ((n + 1) / 2)::BIGINT AS span, event_type AS name, ts AS start, finish, (epoch_us(finish) - epoch_us(ts)) AS elapsed_us FROM w WHERE n % 2 = 1)"""
LIMITS = [60e6, 600e6, 3600e6, 6 * 3600e6, 24 * 3600e6]


@query(f"WITH {_SPANS} SELECT owner, span, name, start, finish, elapsed_us FROM p")
def span_pairs(s, d):
    return metrics.spans(T(s, d, "events"), "user_id")


@query(
    f"WITH {_SPANS} SELECT name, count(*) AS n, max(finish) AS last_finish, max(elapsed_us) AS longest_us, arg_max(owner, (elapsed_us, -epoch_us(start), -owner)) AS longest_owner FROM p WHERE finish IS NOT NULL GROUP BY name"
)
def span_extremes(s, d):
    return metrics.span_extremes(metrics.spans(T(s, d, "events"), "user_id"))


def _first(i: int) -> str:
    low = f"elapsed_us >= {LIMITS[i - 1]:.0f} AND " if i else ""
    return f"count(*) FILTER ({low}elapsed_us < {LIMITS[i]:.0f}) AS b{i}"


@query(f"WITH {_SPANS} SELECT name, count(elapsed_us) AS completed, min(elapsed_us) AS min, max(elapsed_us) AS max, sum(elapsed_us)::BIGINT AS sum, sum(elapsed_us)::DOUBLE / count(elapsed_us) AS mean, {', '.join(map(_first, range(len(LIMITS))))} FROM p GROUP BY name")
def span_latency_histogram(s, d):
    h = metrics.exclusive_histogram(metrics.spans(T(s, d, "events"), "user_id"), ["name"], "elapsed_us", LIMITS)
    return h.select("name", "completed", "min", "max", "sum", "mean", *[F.get("values", F.lit(i)).alias(f"b{i}") for i in range(len(LIMITS))])


@query(
    f"WITH {_SPANS}, c AS (SELECT name, CASE {' '.join(f'WHEN elapsed_us < {x:.0f} THEN {i}' for i, x in enumerate(LIMITS))} END AS bucket, owner % 2 = 0 AS is_error FROM p) SELECT name, bucket, is_error, count(*) AS n FROM c WHERE bucket IS NOT NULL GROUP BY ALL"
)
def span_latency_counter(s, d):
    found = metrics.spans(T(s, d, "events"), "user_id")
    return metrics.latency_counter(found, "name", "elapsed_us", F.col("owner") % 2 == 0, LIMITS)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100")
def metric_recent(s, d):
    return metrics.recent(T(s, d, "events"), ["user_id"]).select("event_id", "user_id")


@query("SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS offset_us FROM events")
def metric_offsets(s, d):
    return metrics.offsets(T(s, d, "events"), "user_id").select("event_id", "offset_us")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS label FROM events")
def metric_carried_label(s, d):
    e = T(s, d, "events").withColumn("label", F.when(F.col("event_type") == "error", F.col("value")))
    return metrics.carry_labels(e, "user_id", "label").select("event_id", "label")


@query("SELECT event_type AS kind, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percent FROM events GROUP BY event_type")
def metric_kind_percent(s, d):
    return metrics.node_percent(T(s, d, "events"), "event_type")


@query("SELECT lang, source, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines, grouping(lang, source)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source)")
def line_counts(s, d):
    return metrics.line_counts(T(s, d, "documents"), ["lang", "source"], metrics.newline_count(F.col("text")))


# ---- search over part names


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def symbol_exact(s, d):
    return T(s, d, "part").where(search.exact("ring", F.col("p_name")) > 0).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'small')")
def symbol_prefix(s, d):
    return T(s, d, "part").where(search.prefix("small", F.col("p_name")) > 0).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE ends_with(lower(p_name), 'widget')")
def symbol_suffix(s, d):
    return T(s, d, "part").where(search.suffix("widget", F.col("p_name")) > 0).select("p_partkey", "p_name")


@query("SELECT p_name AS name, 1.0::DOUBLE AS score FROM part WHERE starts_with(lower(p_name), 's') AND ends_with(lower(p_name), 'g') ORDER BY length(p_name), p_name LIMIT 100")
def symbol_compiled_top(s, d):
    names = T(s, d, "part").select(F.col("p_name").alias("name"))
    return search.ranked(names, search.compile_query("^s g$", F.col("name"))).select("name", "score")


@query()
def symbol_fuzzy_top(s, d):
    names = T(s, d, "part").select(F.col("p_name").alias("name"))
    return search.ranked(names, search.compile_query("rdwg", F.col("name"))).select("name", "score")


# ---- code-index joins


@query(
    """WITH t AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000), u AS (SELECT p_partkey FROM part WHERE p_size > 40)
      SELECT l_suppkey, l_partkey, l_orderkey AS ref FROM lineitem WHERE l_suppkey IN (FROM t) AND l_partkey IN (FROM u)"""
)
def xref_lookup(s, d):
    index = T(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.collect_list("l_orderkey").alias("refs"))
    poor = T(s, d, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("l_suppkey"))
    large = T(s, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    targets = index.select("l_suppkey", "l_partkey").join(poor, "l_suppkey", "left_semi").join(large, "l_partkey", "left_semi")
    return codeindex.lookup_refs(index, targets, ["l_suppkey", "l_partkey"])


@query(
    """WITH c AS (SELECT DISTINCT l_suppkey AS type, l_partkey % 40 AS m FROM lineitem WHERE l_quantity = 50), i AS (SELECT DISTINCT l_orderkey AS interface, l_partkey % 40 AS m FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08),
      z AS (SELECT interface, count(*) AS n FROM i GROUP BY 1) SELECT type, interface FROM c JOIN i USING (m) JOIN z USING (interface) GROUP BY type, interface, n HAVING count(*) = n"""
)
def implements_join(s, d):
    li = T(s, d, "lineitem").withColumn("m", F.concat(F.lit("m"), F.col("l_partkey") % 40))
    concrete = li.where("l_quantity = 50").groupBy(F.col("l_suppkey").alias("type")).agg(F.collect_set("m").alias("methods"))
    wanted = li.where("l_discount = 0.1D AND l_tax = 0.08D").groupBy(F.col("l_orderkey").alias("interface")).agg(F.collect_set("m").alias("methods"))
    return codeindex.implements(concrete, wanted)


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def lookup_division(s, d):
    return codeindex.provide_all(T(s, d, "lineitem"), "l_partkey", "l_returnflag", ["A", "R", "N", "A"])


@query(
    f"""WITH {_SPANS}, q AS (SELECT owner, epoch_us(start) AS lo, epoch_us(finish) AS hi, span FROM p WHERE finish IS NOT NULL)
      SELECT e.event_id, arg_min(q.span, (q.hi - q.lo, q.lo, q.span)) AS span FROM events e JOIN q ON q.owner = e.user_id AND epoch_us(e.ts) BETWEEN q.lo AND q.hi GROUP BY e.event_id"""
)
def interval_innermost(s, d):
    e = T(s, d, "events")
    spans = metrics.spans(e, "user_id").where("finish IS NOT NULL").select("owner", metrics.micros("start").alias("lo"), metrics.micros("finish").alias("hi"), "span")
    points = e.select("event_id", F.col("user_id").alias("owner"), metrics.micros("ts").alias("at"))
    return codeindex.innermost(points, spans, ["owner"], 6 * 3600 * 1_000_000).select("event_id", "span")


@query("WITH t AS (SELECT DISTINCT c_nationkey AS i, c_mktsegment AS t FROM customer) SELECT a.i AS a, b.i AS b, count(*) AS shared FROM t a JOIN t b USING (t) WHERE a.i != b.i GROUP BY ALL")
def related_by_tags(s, d):
    return codeindex.related(T(s, d, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS newer, lead(o_orderkey) OVER w AS older FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)")
def newer_older(s, d):
    return codeindex.newer_older(T(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query(
    """WITH f AS (SELECT s_suppkey AS id, 'm' || s_nationkey AS module, unnest(['b' || (s_suppkey % 25), 'b' || ((s_suppkey + 3) % 25)]) AS package FROM supplier)
      SELECT DISTINCT id, module, package FROM f WHERE module IN (SELECT 'm' || n_nationkey FROM nation WHERE n_regionkey IN (1, 3)) AND package IN (SELECT 'b' || (p_partkey % 25) FROM part WHERE p_size > 45)"""
)
def advisory_findings(s, d):
    b = lambda c: F.concat(F.lit("b"), (c % 25).cast("string"))
    key = F.col("s_suppkey")
    affected = F.array(F.struct(F.concat(F.lit("m"), "s_nationkey").alias("module"), F.array(b(key), b(key + 3)).alias("packages")))
    advisories = T(s, d, "supplier").select(key.alias("id"), affected.alias("affected"))
    modules = T(s, d, "nation").where("n_regionkey IN (1, 3)").select(F.concat(F.lit("m"), "n_nationkey").alias("module"))
    imported = T(s, d, "part").where("p_size > 45").select(b(F.col("p_partkey")).alias("package"))
    return codeindex.findings(modules, advisories, imported)


@query("WITH r AS (SELECT c_nationkey AS n, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS refs FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT refs, string_agg(n::VARCHAR, ',' ORDER BY n) AS decls FROM r GROUP BY refs")
def equivalence_classes(s, d):
    c = codeindex.equivalence_classes(T(s, d, "customer").where("c_acctbal > 9000"), "c_nationkey", "c_mktsegment")
    return c.select(F.array_join("refs", ",").alias("refs"), F.array_join(F.transform("decls", lambda x: x.cast("string")), ",").alias("decls"))


@query("SELECT l_partkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) AS positions FROM lineitem GROUP BY 1")
def inverted_index(s, d):
    p = codeindex.postings(T(s, d, "lineitem"), "l_partkey", "l_orderkey")
    return p.select("l_partkey", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("SELECT target, caller, count(*) AS n FROM (SELECT e.event_type AS target, e.user_id AS caller FROM events e) GROUP BY ALL")
def incoming_calls(s, d):
    e = T(s, d, "events")
    return e.groupBy(F.col("event_type").alias("target"), F.col("user_id").alias("caller")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT p_brand AS name, p_size AS a, p_partkey % 10 AS b, p_partkey FROM part)
      SELECT name, arg_max('v1.' || a || '.' || b, (a, b)) AS best FROM v GROUP BY name"""
)
def best_version(s, d):
    p = T(s, d, "part").withColumn("v", F.concat_ws(".", F.lit("v1"), "p_size", F.col("p_partkey") % 10))
    return p.groupBy(F.col("p_brand").alias("name")).agg(F.max_by("v", text.semver_key(F.col("v"))).alias("best"))


# ---- text


@query("SELECT page_id, NOT regexp_matches(url, '/(es|fr)/') OR regexp_matches(url, '/fr/') AS keep FROM pages")
def path_filter(s, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    return T(s, d, "pages").select("page_id", text.path_filter(path, ["-**/es", "+**/fr"]).alias("keep"))


@query("SELECT event_id, CASE WHEN event_id & 15 = 7 THEN false WHEN event_id & 3 = 1 THEN true ELSE false END AS enabled FROM events")
def bisect_enabled(s, d):
    return T(s, d, "events").select("event_id", text.bisect_enabled(F.col("event_id"), "01-x7").alias("enabled"))


@query("SELECT doc_id, NOT contains(left(text, 1000), 'Copyright') AS missing FROM documents")
def header_check(s, d):
    return T(s, d, "documents").select("doc_id", text.needs_header(F.lit("x.py"), F.col("text"), "Copyright").alias("missing"))


_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_DECODED = "replace(replace(replace(replace(replace(replace(" + _BARE + ", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(rf"SELECT page_id, md5(trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'))) AS digest FROM pages")
def html_text(s, d):
    return T(s, d, "pages").select("page_id", F.md5(text.text_of_html(F.col("html"))).alias("digest"))


@query()
def diff_round_trip(s, d):
    """Edits between a page's html and its text, and whether applying them gives the text."""
    p = T(s, d, "pages").select("page_id", "html", text.text_of_html(F.col("html")).alias("t"))
    return p.select("page_id", render.round_trip(F.col("html"), F.col("t")).alias("r")).select("page_id", "r.n", "r.ok")


# ---- output formats


@query(
    f"""WITH {_GEO}, q AS (SELECT 1 AS part, src AS a, '' AS b FROM g UNION SELECT 1, dst, '' FROM g UNION SELECT 2, src, dst FROM g)
      SELECT part, a, b, CASE WHEN part = 1 THEN '  "' || a || '";' ELSE '  "' || a || '" -> "' || b || '";' END AS line FROM q"""
)
def dot_lines(s, d):
    e = geo(s, d)
    return render.dot_lines(graph.nodes_of(e), e)


@query(
    """WITH h AS (SELECT 'event_type="' || event_type || '"' AS series, count(*) AS n, """
    + ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS))
    + """ FROM events GROUP BY event_type)
      SELECT series, unnest(["""
    + ", ".join(f"""'value_bucket{{' || series || ',le="{b:g}"}} ' || b{i}""" for i, b in enumerate(BOUNDS))
    + """, 'value_bucket{' || series || ',le="+Inf"} ' || n, 'value_count{' || series || '} ' || n]) AS line FROM h"""
)
def exposition_lines(s, d):
    h = metrics.histogram(T(s, d, "events"), ["event_type"], "value", BOUNDS)
    return render.exposition(h, "value", ["event_type"], BOUNDS).where(~F.startswith("line", F.lit("value_sum")))


# ---- streaming over the events folder


def _stream(s: SparkSession, d: str) -> tuple[DataFrame, str, str]:
    ensure_checkpoint_dir(s)
    path = f"{d}/events.parquet"
    folder = s.sparkContext._jsc.sc().getCheckpointDir().get() + f"/stream-{uuid.uuid4().hex}"
    where, files = (path, "*.parquet") if os.path.isdir(path) else (d, "events.parquet")
    return streams.read_events(s, where, s.read.parquet(path).schema, files), folder, f"out_{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum FROM events GROUP BY event_type")
def stream_counts(s, d):
    e, folder, name = _stream(s, d)
    return streams.run_once(streams.counts(e, ["event_type"], "value"), folder, "complete", name).withColumn("sum", F.round("sum", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS count FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    e, folder, name = _stream(s, d)
    out = streams.run_once(streams.tumbling(e, ["event_type"], "ts", "1 hour", "1 hour"), folder, "complete", name)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH a AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS count FROM b GROUP BY user_id, k"""
)
def stream_sessions(s, d):
    e, folder, name = _stream(s, d)
    out = streams.run_once(streams.sessions(e, "user_id", "ts", "2 hours", "1 hour"), folder, "complete", name)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})




@query(
    """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, event_type, count(*) AS count FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL"""
)
def stream_sliding(s, d):
    e, folder, name = _stream(s, d)
    out = streams.run_once(streams.sliding(e, ["event_type"], "ts", "1 hour", "30 minutes", "1 hour"), folder, "complete", name)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"WITH {_SPANS} SELECT owner * 1000000 + span AS span_id, name, finish - start < INTERVAL 6 HOUR AS short FROM p WHERE finish IS NOT NULL AND finish <= start + INTERVAL 12 HOUR")
def stream_span_join(s, d):
    """Start and end marks as two streams, joined within a longest duration."""
    ensure_checkpoint_dir(s)
    base = s.sparkContext._jsc.sc().getCheckpointDir().get() + f"/spans-{uuid.uuid4().hex}"
    rows = metrics.spans(T(s, d, "events"), "user_id").where("finish IS NOT NULL").withColumn("span_id", F.col("owner") * 1000000 + F.col("span"))
    rows.select("span_id", F.col("start").cast("timestamp").alias("start"), "name").write.parquet(f"{base}/starts")
    rows.select("span_id", F.col("finish").cast("timestamp").alias("finish")).write.parquet(f"{base}/ends")
    read = lambda x: s.readStream.schema(s.read.parquet(f"{base}/{x}").schema).parquet(f"{base}/{x}")
    joined = streams.paired_spans(read("starts"), read("ends"), "1 day", "12 hours")
    out = streams.run_once(joined, f"{base}/checkpoint", "append", f"out_{uuid.uuid4().hex}")
    return out.select("span_id", "name", (F.col("finish") - F.col("start") < F.expr("INTERVAL 6 HOURS")).alias("short"))


# ---- orders, closures and statistics


@query("SELECT conv_id, turn AS id, count(*) OVER (PARTITION BY conv_id) - 1 - row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS ord FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations) WHERE c > 1")
def order_postorder(s, d):
    """Turns of a conversation lead to the next: the last comes first."""
    c = T(s, d, "conversations")
    from pyspark.sql import Window

    e = c.select("conv_id", F.col("turn").alias("src"), F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("dst")).where("dst IS NOT NULL")
    return ordering.postorder_of_each(e, "conv_id")


@query(
    f"""WITH RECURSIVE {_GEO}, t AS (SELECT dst AS id, src AS parent FROM g UNION SELECT 'r' || r_regionkey, '*' FROM region),
      w(id, path, depth) AS (SELECT '*', ['*'], 0 UNION ALL SELECT t.id, list_append(w.path, t.id), depth + 1 FROM w JOIN t ON t.parent = w.id),
      z AS (SELECT a.above AS id, count(*) AS size FROM (SELECT unnest(path) AS above FROM w) a GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS pre FROM w)
      SELECT id, pre, pre + size - 1 AS post, depth FROM n JOIN z USING (id)"""
)
def order_tree_intervals(s, d):
    top = T(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("*").alias("parent"))
    tree = geo(s, d).select(F.col("dst").alias("id"), F.col("src").alias("parent")).unionByName(top)
    return ordering.tree_intervals(tree, s.createDataFrame([("*",)], "id string"))


@query(f"WITH RECURSIVE {S}, q(root, id) AS (SELECT id, id FROM v WHERE id IN (0, 3, 5) UNION SELECT q.root, e.dst FROM q JOIN e ON e.src = q.id) SELECT root, id FROM q")
def g_reachable_from_each(s, d):
    return ordering.reachable_from_each(refs(s, d, "supplier"), one(s, 0, 3, 5))


@query(f"WITH RECURSIVE {C}, {_FWD.format(0)} SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM f) AS reachable")
def g_statistics(s, d):
    return ordering.statistics(refs(s, d, "customer"), one(s, 0))


@query(f"WITH RECURSIVE {S}, {_PAIRS}, o AS (SELECT a, b FROM p UNION SELECT id, id FROM v) SELECT o.b AS id, s_nationkey AS key, max(s_suppkey) AS value FROM o JOIN supplier ON s_suppkey = o.a WHERE s_acctbal > 5000 GROUP BY ALL")
def flow_maps(s, d):
    e = refs(s, d, "supplier")
    start = T(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("value"))
    return ordering.forward_keyed(graph.nodes_of(e), e, start, lambda src, dst, v: v, F.max, F.lit(-1))


# ---- quantifiers, filters, upserts


@query("SELECT bool_and(c_acctbal > 0) AS every, bool_or(c_acctbal > 9000) AS any, count(*) AS len, count(*) = 0 AS empty FROM customer")
def seq_quantified(s, d):
    c = T(s, d, "customer")
    every, some = sequences.quantified(c, F.col("c_acctbal") > 0), sequences.quantified(c, F.col("c_acctbal") > 9000)
    return every.select("every", "len", "empty").join(F.broadcast(some.select("any", "len")), "len").select("every", "any", "len", "empty")


@query("SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM customer GROUP BY 1")
def seq_grouped(s, d):
    g = sequences.grouped(T(s, d, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", "c_custkey")
    return g.select("c_nationkey", F.array_join(F.transform("rows", lambda r: r["c_name"]), ",").alias("names"))


@query("SELECT count(*) AS held, 0::BIGINT AS missed, true AS mostly_rejects FROM supplier")
def bloom_contract(s, d):
    """No key that is held is missed, and few others pass."""
    keys = T(s, d, "supplier")
    f = bloom.BloomFilter(keys, "s_suppkey")
    own = keys.select(f.may_contain(F.col("s_suppkey")).alias("may"), F.lit(True).alias("own"))
    other = T(s, d, "orders").select(f.may_contain(-1 - F.col("o_orderkey")).alias("may"), F.lit(False).alias("own"))
    both = own.unionByName(other)
    return both.agg(F.count_if("own").alias("held"), F.count_if(F.col("own") & ~F.col("may")).alias("missed"), (F.count_if(~F.col("own") & F.col("may")) < 0.15 * F.count_if(~F.col("own"))).alias("mostly_rejects"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT s_suppkey + 10000000, s_acctbal FROM supplier")
def set_upsert(s, d):
    c = T(s, d, "customer").select("c_custkey", "c_acctbal")
    new = T(s, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return sets.upsert(c, c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(new), ["c_custkey"])


@query("SELECT page_id, regexp_matches(url, '^[a-z]+://[^/]*/(.*/)?(en|de)/[^/]*$') AS hit FROM pages")
def glob_match(s, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/(.*)$", 1)
    return T(s, d, "pages").select("page_id", text.glob_match(path, "**/{en,de}/*").alias("hit"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS before, regexp_extract(url, '[^/]*$') AS after FROM pages")
def cut_last(s, d):
    return T(s, d, "pages").select("page_id", text.cut_last(F.col("url"), "/").alias("c")).select("page_id", "c.before", "c.after")


@query(
    """SELECT l_suppkey, start FROM (SELECT l_suppkey, l_partkey AS start, max(l_partkey + l_quantity::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_partkey + l_quantity::BIGINT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lineitem)
      WHERE b > start"""
)
def interval_conflicts(s, d):
    li = T(s, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return codeindex.interval_conflicts(li, ["l_suppkey"]).select("l_suppkey", "start")


@query("SELECT c_mktsegment, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def first_by_priority(s, d):
    return codeindex.first_by_priority(T(s, d, "customer"), "c_mktsegment", F.struct(-F.col("c_acctbal"), F.col("c_custkey"))).select("c_mktsegment", "c_custkey")
