"""Graph and dataflow operators on hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import dataflow, graph


def edges(spark, text):
    """``a>b,c d>e`` as an edge table."""
    rows = [(w.split(">")[0], t) for w in text.split() for t in w.split(">")[1].split(",")]
    return spark.createDataFrame(rows, "src string, dst string")


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(scope="module")
def clothes(spark):
    return edges(spark, "socks>shoes shorts>pants pants>belt,shoes shirt>tie,sweater sweater>jacket")


@pytest.fixture(scope="module")
def loops(spark):
    return edges(spark, "a>b,c b>d c>d d>c e>e")


def test_clothes(spark, clothes):
    every = graph.nodes_of(clothes, nodes(spark, "hat"))
    assert every.count() == 10
    assert ids(graph.reaching(clothes, nodes(spark, "jacket"))) == ["jacket", "shirt", "sweater"]
    assert ids(graph.reachable(clothes, nodes(spark, "socks"))) == ["shoes", "socks"]
    assert graph.transpose(clothes).count() == 7
    deg = {r["id"]: (r["in_degree"], r["out_degree"]) for r in graph.degree(every, clothes).collect()}
    assert deg["hat"] == (0, 0) and deg["shoes"] == (2, 0) and deg["pants"] == (1, 2)
    level = {r["id"]: r["level"] for r in graph.topological_levels(every, clothes).collect()}
    assert level["hat"] == 0 and level["jacket"] == 2 and level["shoes"] == 2


def test_components(spark, loops):
    every = graph.nodes_of(loops)
    found = graph.nontrivial_components(every, loops).collect()
    assert sorted((r["component"], r["id"]) for r in found) == [("c", "c"), ("c", "d"), ("e", "e")]
    assert ids(graph.successors(loops, nodes(spark, "a"))) == ["b", "c"]
    assert ids(graph.predecessors(loops, nodes(spark, "c", "d"))) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        graph.topological_levels(every, loops)


@pytest.mark.parametrize("text, groups", [("A>B B>C C>A", ["A", "A", "A"]), ("A>B", ["A", "B"]), ("A>A", ["A"]), ("A>B B>A C>D,A D>C", ["A", "A", "C", "C"])])
def test_component_labels(spark, text, groups):
    e = edges(spark, text)
    assert [r["component"] for r in graph.strong_components(graph.nodes_of(e), e).orderBy("id").collect()] == groups


def test_all_paths_keep_walks(spark):
    pairs = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    e = edges(spark, "A>B B>A,C C>D")
    assert pairs(graph.all_paths(e, nodes(spark, "A"), nodes(spark, "C"))) == [("A", "B"), ("B", "A"), ("B", "C")]
    e = edges(spark, "A>B B>C,D C>E D>E E>F")
    assert pairs(graph.all_paths(e, nodes(spark, "A"), nodes(spark, "E"))) == [("A", "B"), ("B", "C"), ("B", "D"), ("C", "E"), ("D", "E")]


def test_shortest_path(spark):
    e = edges(spark, "A>B,C B>D C>D D>E")
    assert [r["id"] for r in graph.shortest_path(e, nodes(spark, "A"), nodes(spark, "E")).orderBy("step").collect()] == ["A", "B", "D", "E"]
    assert graph.shortest_path(e, nodes(spark, "A"), nodes(spark, "F")).count() == 0
    assert [r["id"] for r in graph.shortest_path(e, nodes(spark, "A"), nodes(spark, "A")).collect()] == ["A"]
    assert [r["id"] for r in graph.path_to_any(e, nodes(spark, "A"), F.col("id") > "C").orderBy("step").collect()] == ["A", "B", "D"]


def test_bypass(spark):
    e = edges(spark, "a>x x>y,b y>c,x a>b y>y")
    got = sorted((r["src"], r["dst"]) for r in graph.bypass(e, nodes(spark, "x", "y")).collect())
    assert got == [("a", "b"), ("a", "c")]


@pytest.mark.parametrize(
    "pairs, want",
    [
        ([(0, 1), (1, 2), (2, 3)], {0: 0, 1: 1, 2: 3, 3: 7}),
        ([(0, 1), (0, 2), (1, 3), (2, 3)], {0: 0, 1: 1, 2: 1, 3: 7}),
        ([(0, 1), (1, 2), (2, 1)], {0: 0, 1: 7, 2: 7}),
    ],
)
def test_forward_bit_sets(spark, pairs, want):
    e = spark.createDataFrame(pairs, "src long, dst long")
    bit = lambda src: F.call_function("shiftleft", F.lit(1).cast("long"), src.cast("int"))
    facts = dataflow.forward(graph.nodes_of(e), e, None, lambda src, _, f: f.bitwiseOR(bit(src)), F.bit_or, F.lit(0).cast("long"))
    assert {r["id"]: r["fact"] for r in facts.collect()} == want


def test_entry_facts_count_only_without_predecessors(spark):
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    entry = spark.createDataFrame([(0, 5), (1, 99)], "id long, fact long")
    facts = dataflow.forward(graph.nodes_of(e), e, entry, lambda s, d, f: f, F.max, F.lit(-1).cast("long"))
    assert {r["id"]: r["fact"] for r in facts.collect()} == {0: 5, 1: 5, 2: 5}


def test_dominators_of_a_diamond(spark):
    e = edges(spark, "r>a,b a>c b>c c>d d>c,e")
    dom = dataflow.dominators(e, nodes(spark, "r"))
    assert {r["id"]: r["idom"] for r in dataflow.immediate_dominators(dom).collect()} == {"a": "r", "b": "r", "c": "r", "d": "c", "e": "d"}
    assert sorted((r["id"], r["frontier"]) for r in dataflow.dominance_frontier(e, dom).collect()) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "c")]


def test_propagation_over_a_cycle(spark):
    e = edges(spark, "t0>t1 t1>t2 t2>t0")
    start = spark.createDataFrame([("t0", "A"), ("t1", "B")], "id string, type string")
    assert dataflow.propagate(e, start).count() == 6
