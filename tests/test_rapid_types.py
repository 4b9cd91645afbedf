import random

from pyspark.sql import functions as F

from graphloom.operators import dataflow
from graphloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def plain_rapid_types(roots, static, creates, invokes, methods):
    """Functions and types that are live, by adding one at a time until none is left to add."""
    funcs, types = set(roots), set()
    while True:
        names = {n for f, n in invokes if f in funcs}
        more = {b for a, b in static if a in funcs} | {f for t, n, f in methods if t in types and n in names}
        live = {t for f, t in creates if f in funcs}
        if more <= funcs and live <= types:
            return funcs, types
        funcs |= more
        types |= live


def test_rapid_types(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 30
        pick = lambda k, *most: [tuple(rng.randrange(m) for m in most) for _ in range(k)]
        static, creates, invokes, methods = pick(20, n, n), pick(15, n, 6), pick(15, n, 4), pick(25, 6, 4, n)
        make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names.split()))
        roots = [(static[0][0],), (creates[0][0],)]
        funcs, types = dataflow.rapid_types(make(roots, "id"), make(static, "src dst"), make(creates, "func type"), make(invokes, "func name"), make(methods, "type name func"))
        want = plain_rapid_types([x for (x,) in roots], static, creates, invokes, methods)
        assert ({r[0] for r in funcs.collect()}, {r[0] for r in types.collect()}) == want


def test_query_follows_every_call(spark, monkeypatch):
    seen = []
    whole = dataflow.rapid_types
    monkeypatch.setattr(dataflow, "rapid_types", lambda *frames: seen.extend(frames) or whole(*frames))
    got = {(r["kind"], r["id"]) for r in catalogue.QUERIES["flow_rapid_types"](spark, SMALL).collect()}
    assert seen[1].count() == catalogue.refs(spark, SMALL, "supplier").count() > seen[1].where("src % 3 = 0").count()
    columns = (("id",), ("src", "dst"), ("func", "type"), ("func", "name"), ("type", "name", "func"))
    roots, *rest = [[tuple(r) for r in f.select(*map(F.col, c)).collect()] for f, c in zip(seen, columns)]
    funcs, types = plain_rapid_types([x for (x,) in roots], *rest)
    assert got == {("func", f) for f in funcs} | {("type", t) for t in types}
