"""Orders, quantifiers, Bloom filters, edits and line checks."""

import random

from pyspark.sql import functions as F

from graphloom.operators import bloom, checks, edits, ordering, sequences


def test_quantifiers(spark):
    rows = spark.range(5)
    assert tuple(sequences.quantified(rows, F.col("id") < 3).first()) == (False, True, 5, False)
    assert tuple(sequences.quantified(rows.limit(0), F.col("id") < 3).first()) == (True, False, 0, True)
    assert sequences.contains(rows, "id", 4) and sequences.first(rows, "id").first()["id"] == 0
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    assert spark.range(1).select(sequences.first_wins([m("a", 1), m("a", 2, "b", 3)]).alias("x")).first()["x"] == {"a": 1, "b": 3}


def test_bloom_filter(spark):
    assert bloom.sizes(0) == (1, 1) and bloom.sizes(1000) == (780, 4)
    held = bloom.BloomFilter(spark.range(1000), "id")
    rows = spark.range(3000).select("id", held.may_contain(F.col("id")).alias("may")).collect()
    assert all(r["may"] for r in rows if r["id"] < 1000)
    assert sum(r["may"] for r in rows if r["id"] >= 1000) < 2000 * 0.1


def test_postorder_and_intervals(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "a", "c"), ("g", "b", "d"), ("g", "c", "d"), ("g", "d", "b"), ("h", "x", "x")], "g string, src string, dst string")
    order = {(r["g"], r["id"]): r["ord"] for r in ordering.postorder_of_each(e, "g").collect()}
    assert order[("g", "a")] == 3 and order[("h", "x")] == 0 and order[("g", "d")] < order[("g", "b")] < order[("g", "a")]
    t = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("f", "c")], "id string, parent string")
    got = {r["id"]: (r["pre"], r["post"], r["depth"]) for r in ordering.tree_intervals(t, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": (0, 5, 0), "b": (1, 3, 1), "d": (2, 2, 2), "e": (3, 3, 2), "c": (4, 5, 1), "f": (5, 5, 2)}


def test_closures_and_preferences(spark):
    e = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("a", "c", False)], "src string, dst string, static boolean")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(map(tuple, ordering.reachable_from_each(e, ids("a", "b")).collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c")]
    assert [r["id"] for r in ordering.preferred_path(e, ids("a"), ids("c"), F.col("static")).orderBy("step").collect()] == ["a", "b", "c"]
    assert ordering.preferred_path(e.where("dst = 'c' AND src = 'a'"), ids("a"), ids("c"), F.col("static")).count() == 2
    assert tuple(ordering.statistics(e, ids("b")).first()) == (3, 3, 2)
    start = spark.createDataFrame([("a", "k", 1), ("b", "k", 5), ("b", "l", 2)], "id string, key string, value int")
    got = sorted(map(tuple, ordering.forward_keyed(ids("a", "b", "c"), e, start, lambda s, d, v: v, F.max, F.lit(0)).collect()))
    assert got == [("a", "k", 1), ("b", "k", 5), ("b", "l", 2), ("c", "k", 5), ("c", "l", 2)]


def test_package_indexes(spark):
    p = spark.createDataFrame([("a", "p/a", ["x.s"], ["b"], False), ("a.test", "p/a", ["x.s", "t.s"], ["b"], True), ("b", "p/b", ["y.s"], [], False)], "id string, path string, files array<string>, imports array<string>, is_test boolean")
    views = ordering.package_indexes(p)
    assert {r["id"]: r["importers"] for r in views["imported_by"].collect()} == {"b": ["a", "a.test"]}
    assert {r["path"]: r["ids"] for r in views["by_path"].collect()}["p/a"] == ["a", "a.test"]
    assert {r["file"]: r["ids"] for r in views["by_file"].collect()}["x.s"] == ["a", "a.test"]


def test_edits(spark):
    assert edits.merge([(0, 1, "x")], [(0, 1, "x"), (3, 4, "y")]) == [(0, 1, "x"), (3, 4, "y")]
    assert edits.merge([(0, 2, "x")], [(1, 3, "y")]) is None and edits.merge([(1, 1, "x")], [(1, 1, "y")]) is None
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("ab\n", k=rng.randint(0, 20)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 2))))
        some = [(cuts[k], cuts[k + 1], rng.choice(["", "q", "r\ns"])) for k in range(0, len(cuts) - 1, 2)]
        use = lambda es: "".join([text[a:b] if n is None else n for a, b, n in fill(es, len(text))])  # noqa: E731, B023
        assert use(edits.widen(text, some)) == use(some), (text, some)
    diff = "--- a\n+++ b\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n"
    assert edits.apply_unified(diff, "one\ntwo\nthree\n") == "one\nTWO\nthree\n"
    s = "array<struct<start:int,end:int,new:string>>"
    df = spark.createDataFrame([([(0, 1, "x")], [(2, 3, "y")]), ([(0, 2, "x")], [(1, 3, "y")])], f"p {s}, q {s}")
    out = [r["m"] for r in df.select(edits.merged(F.col("p"), F.col("q")).alias("m")).collect()]
    assert len(out[0]) == 2 and out[1] is None


def fill(es, n):
    at, out = 0, []
    for a, b, new in sorted(es):
        assert a >= at
        out += [(at, a, None), (a, b, new)]
        at = b
    return [*out, (at, n, None)]


def test_line_checks(spark):
    files = {
        "a.x": ["//go:build linux", "// +build linux", "", 'package a // import "x/a"', "//go:build late", "var t = f(\"2006-02-01\")", 'Printf("%d %s", a)', 'Printf("%d%%", a)', "A int `json:\"a\"`", "B int `json:a`"],
        "b_test.go": ["package b", "func Testbad(t *testing.T) {", "func TestGood(t *testing.T) {", "x interface{}", "//go:embed f", "T time.Time `json:\"t,omitempty\"`"],
        "gen.x": ["// Code generated by x. DO NOT EDIT.", "package g", "x interface{}"],
    }
    rows = [(f, i, t) for f, ls in files.items() for i, t in enumerate(ls)]
    got = {(r["file"], r["line"], r["category"]) for r in checks.run(spark.createDataFrame(rows, "file string, line int, text string")).collect()}
    assert got == {
        ("a.x", 1, "plusbuild"), ("a.x", 3, "importcomment"), ("a.x", 4, "buildtag"), ("a.x", 5, "timeformat"), ("a.x", 6, "printf"), ("a.x", 9, "structtag"),
        ("b_test.go", 1, "tests"), ("b_test.go", 3, "any"), ("b_test.go", 4, "embed"), ("b_test.go", 5, "omitzero"),
    }
    req = spark.createDataFrame([("vet", "inspect"), ("deep", "vet")], "analyzer string, needs string")
    ids = spark.createDataFrame([("vet",), ("inspect",), ("deep",)], "id string")
    assert {r["id"]: r["level"] for r in checks.required_order(req, ids).collect()} == {"inspect": 0, "vet": 1, "deep": 2}
