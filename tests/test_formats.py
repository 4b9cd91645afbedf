"""Parsers, comparison, coverage, sets, search, text and output formats on golden cases."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import fuzzy, render, text
from graphloom.operators import codeindex, compare, coverage, sets
from graphloom.sources import text_formats as src


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_digraph_text(spark):
    nodes, edges = src.digraph(strings(spark, "socks shoes", "hat", "", '"a b"\\c x"\\n"y', "x " + "w" * 98304, "socks shoes"))
    assert {r["id"] for r in nodes.collect()} >= {"hat", "a b\\c", "x\ny", "w" * 98304}
    assert edges.count() == 3
    with pytest.raises(ValueError):
        src.split_words('a "b')


def test_benchmark_lines(spark):
    lines = [
        "BenchmarkEncrypt\t100000000\t19.6 ns/op", "BenchmarkEncrypt\t5000000\t517 ns/op\t1.5 MB/s", "BenchmarkNoUnit 10 19.6", "BenchmarkA 10 5 ns/op 7 B/op 3 allocs/op", "BenchPress 100 19.6 ns/op",
        "BenchmarkLots lots 19.6 ns/op", "BenchmarkSmoots 100 19.6 smoots", "PASS",
    ]
    rows = src.benchmark_rows(spark.createDataFrame(list(enumerate(lines)), "line int, value string")).orderBy("ord").collect()
    assert [(r["name"], r["n"], r["measured"]) for r in rows] == [("BenchmarkEncrypt", 100000000, 1), ("BenchmarkEncrypt", 5000000, 3), ("BenchmarkNoUnit", 10, 0), ("BenchmarkA", 10, 13), ("BenchmarkSmoots", 100, 0)]
    assert rows[1]["mb_per_s"] == 1.5 and rows[3]["alloced_bytes_per_op"] == 7 and rows[3]["allocs_per_op"] == 3


def test_cover_lines(spark):
    lines = [("p", "mode: set"), ("p", "some/fancy:path, x.y:42.69,44.16 2 1"), ("p", "some/fancy:path, x.y:42.69,44.16 2 0"), ("q", "mode: count"), ("q", "b.c:1.2,3.4 5 6"), ("q", "b.c:1.2,3.4 5 7")]
    rows = src.cover_rows(spark.createDataFrame(lines, "profile string, value string"))
    merged = {r["file"]: r["count"] for r in coverage.merge(rows).collect()}
    assert merged == {"some/fancy:path, x.y": 1, "b.c": 13}
    with pytest.raises(Exception, match="bad coverage line"):
        src.cover_rows(spark.createDataFrame([("p", "mode: set"), ("p", "x:1.2,3.4 5 -1")], "profile string, value string")).collect()
    with pytest.raises(Exception, match="inconsistent"):
        coverage.merge(rows.withColumn("num_stmt", F.col("count").cast("int"))).collect()


def test_archives(spark):
    body = "comment\n-- a.txt --\nline\n-- b/c --\nlast"
    files = src.archive_files(spark.createDataFrame([("z", body), ("e", "")], "archive string, text string"), "archive", "text")
    got = {(r["archive"], r["name"]): r["data"] for r in files.collect()}
    assert got == {("z", ""): "comment\n", ("z", "a.txt"): "line\n", ("z", "b/c"): "last\n", ("e", ""): ""}
    assert {r["archive"]: r["text"] for r in src.format_archive(files).collect()}["z"] == body + "\n"
    assert src.duplicate_names(files).count() == 0


def test_index_entries_and_messages(spark):
    lines = [(0, ":fmt,a/fmt,dir,v1.0.0", "f"), (1, "Print F 1 x int$a", "f"), (2, ":os,os,d2,v2.0.0", "f"), (3, "Exit FD 0", "f")]
    rows = src.index_entries(spark.createDataFrame(lines, "line int, value string, file string")).orderBy("symbol").collect()
    assert [(r["pkg_name"], r["symbol"], r["kind"], r["deprecated"]) for r in rows] == [("os", "Exit", "F", True), ("fmt", "Print", "F", False)] and rows[1]["signature"][-1] == "int a"
    m = src.wire_messages(strings(spark, '{"id":1,"method":"a"}', '{"method":"b"}', '{"id":1,"result":{"x":2}}', "{}"))
    assert [r["kind"] for r in m.collect()] == ["call", "notification", "response", "invalid"]
    t = src.tagged_messages(strings(spark, '{"osv":{"id":"X"}}', '{"finding":{"a":1}}', '{"other":1}'), ["osv", "finding"])
    assert sorted(r["kind"] for r in t.collect()) == ["finding", "osv"]
    n = src.notes(strings(spark, 'x := 1 //@def("x", y), mark(z)', "plain"))
    assert [(r["name"], r["args"]) for r in n.collect()] == [("def", '"x", y')]


def bench(spark, rows):
    schema = "name string, ord int, n long, ns_per_op double, mb_per_s double, alloced_bytes_per_op long, allocs_per_op long, measured int"
    return spark.createDataFrame([(n, o, 1, float(v), None, None, None, 1) for n, o, v in rows], schema)


def test_correlate_and_best(spark):
    before = bench(spark, [("OneEach", 0, 1), ("OneToNone", 1, 1), ("OneToTwo", 2, 1), ("TwoToOne", 3, 1), ("TwoToOne", 4, 1), ("TwoEach", 5, 1), ("TwoEach", 6, 1)])
    after = bench(spark, [("OneEach", 0, 1), ("NoneToOne", 1, 1), ("TwoToOne", 2, 1), ("OneToTwo", 3, 1), ("OneToTwo", 4, 1), ("TwoEach", 5, 1), ("TwoEach", 6, 1)])
    assert sorted(r["name"] for r in compare.correlate(before, after).collect()) == ["OneEach", "TwoEach", "TwoEach"]
    assert sorted(r["name"] for r in compare.unmatched(before, after).collect()) == ["OneToTwo", "TwoToOne"]
    rows = bench(spark, [("B1", 0, 100), ("B2", 1, 60), ("B2", 2, 500), ("B1", 3, 50)])
    assert {r["name"]: (r["ns_per_op"], r["ord"]) for r in compare.best(rows).collect()} == {"B1": (50.0, 0), "B2": (60.0, 1)}


def test_deltas(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], "b double, a double")
    r = compare.ratio(F.col("b"), F.col("a"))
    got = [tuple(x) for x in rows.select(compare.magnitude(F.col("b"), F.col("a")), r, compare.percent_text(r), compare.multiple_text(r)).collect()]
    assert [g[0] for g in got] == [1, 0.5, 0.5, 1, inf, inf] and [g[1] for g in got] == [1, 2, 0.5, 1, 0, inf]
    assert got[5][2:] == ("+Inf%", "+Infx") and got[1][2:] == ("+100.00%", "2.00x")
    pairs = compare.correlate(bench(spark, [("MuchFaster", 3, 10), ("SameB", 1, 5), ("SameA", 2, 5), ("Slower", 0, 10)]), bench(spark, [("MuchFaster", 3, 1), ("SameB", 1, 5), ("SameA", 2, 5), ("Slower", 0, 11)]))
    found = compare.deltas(pairs, "ns_per_op")
    assert [r["name"] for r in compare.by_delta(found).collect()] == ["MuchFaster", "Slower", "SameA", "SameB"]
    assert [r["name"] for r in compare.by_parse_order(found).collect()] == ["Slower", "SameB", "SameA", "MuchFaster"]
    texts = [one(spark, compare.format_ns(F.lit(v))) for v in (0.0, 0.2, 2.2, 16.08, 256.2)]
    assert texts == ["0.00", "0.20", "2.20", "16.1", "256"]


def test_runs_and_bit_text(spark):
    rows = spark.createDataFrame([("g", v) for v in (1, 2, 3, 5, 6, 7, 7)], "g string, v long")
    assert sorted((r["first"], r["last"], r["n"]) for r in sets.runs(rows, ["g"], "v").collect()) == [(1, 3, 3), (5, 7, 3)]
    assert sets.bit_text([]) == "0" and sets.bit_text([0, 2]) == "101" and sets.bit_text([-1, 1]) == "10.1"
    x = rows.select("v")
    assert sets.text(x).first()["text"] == "{1 2 3 5 6 7}" and sets.has(x, 5) and not sets.has(sets.remove(x, 5), 5)
    assert sets.summary(x.limit(0), 3).first()["min"] == sets.MOST and [r["v"] for r in sets.take_min(x)[0].collect()] == [1]


def test_maps(spark):
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    a, b = m(x=1, y=2), m(y=5, z=6)
    assert one(spark, sets.map_merge(a, b)) == {"x": 1, "y": 2, "z": 6}
    assert one(spark, sets.map_merge_with(a, b, lambda p, q: p + q)) == {"x": 1, "y": 7, "z": 6}
    assert one(spark, sets.map_intersect(a, b)) == {"y": 2} and one(spark, sets.map_intersect_with(a, b, lambda p, q: p * q)) == {"y": 10}
    assert one(spark, sets.map_insert(a, F.lit("x"), F.lit(9)))["x"] == 1 and one(spark, sets.map_update(a, F.lit("x"), F.lit(9)))["x"] == 9
    assert not one(spark, sets.same_keys(a, b)) and one(spark, sets.map_remove(a, F.lit("x"))) == {"y": 2}


SCORES = [("abc", "abd", 0), ("abc", "abc", 1), ("abc", "Abc", 1), ("up", "unique_ptr", 0.75), ("up", "upper_bound", 1)]


@pytest.mark.parametrize("pattern, name, want", SCORES)
def test_fuzzy_scores(pattern, name, want):
    assert round(fuzzy.Matcher(pattern).match(name).score, 5) == want


def test_symbol_scores(spark):
    assert [fuzzy.symbol_match(*x)[0] for x in (("test", "foo.TestFoo"), ("test", "test"), ("test", "est"), ("t", "shortest"), ("", "foo"), ("anything", ""))] == [4, 0, -1, 7, -1, -1]
    ranked = "foo.test tTest testage test.foo atest thebest test.foo.bar this.is.better.than.most".split()[::-1]
    assert sorted(ranked, key=lambda s: fuzzy.symbol_match("test", s)[1]) == ranked
    assert fuzzy.Matcher("fb").match("FooBar").ranges == [(0, 1), (3, 4)] and fuzzy.words("fooBarBaz") == ["foo", "Bar", "Baz"]
    df = strings(spark, "foo.test", None)
    assert df.select(fuzzy.symbol_score("test", F.col("value")).alias("s")).first()["s"] > 0.9


def test_versions_and_paths(spark):
    order = ["1.2rc1", "1.2rc2", "1.2", "1.2.1", "1.10", "2.0"]
    df = strings(spark, *reversed(order)).orderBy(text.version_key(F.col("value")))
    assert [r["value"] for r in df.collect()] == order
    sem = ["v1.0.0-alpha", "v1.0.0-alpha.1", "v1.0.0-alpha.beta", "v1.0.0-beta.2", "v1.0.0-beta.11", "v1.0.0", "v1.2.0", "v1.10.0"]
    assert [r["value"] for r in strings(spark, *reversed(sem)).orderBy(text.semver_key(F.col("value"))).collect()] == sem
    assert one(spark, text.path_distance(F.lit("a/b/c"), F.lit("a/d"))) == 3 and one(spark, text.path_distance(F.lit("a/b"), F.lit("a/b/c/d"))) == 2
    cut = one(spark, text.cut_last(F.lit("a/b/c"), "/"))
    assert (cut["before"], cut["after"], cut["ok"]) == ("a/b", "c", True)
    assert one(spark, text.within(F.lit("/a/b"), F.lit("/a"))) and not one(spark, text.within(F.lit("/ab"), F.lit("/a")))
    assert one(spark, text.may_import(F.lit("a/b"), F.lit("a/internal/x"))) and not one(spark, text.may_import(F.lit("c"), F.lit("a/internal/x")))
    for glob, path, hit in (("**/*.py", "a/b/c.py", True), ("*.py", "a/c.py", False), ("{a,b}?[!x]", "b1y", True), ("a[0-9]", "ax", False)):
        assert one(spark, text.glob_match(F.lit(path), glob)) == hit
    for path, hit in (("a/node_modules/x", False), ("a/b", True), ("a/node_modules/keep", True)):
        assert one(spark, text.path_filter(F.lit(path), ["-**/node_modules", "+**/node_modules/keep"])) == hit


def test_bisect(spark):
    ids = spark.range(16)
    assert [r["id"] for r in ids.where(text.bisect_enabled(F.col("id"), "01-101")).collect()] == [1, 9]
    assert [r["id"] for r in ids.where(text.bisect_enabled(F.col("id"), "!1")).collect()] == [0, 2, 4, 6, 8, 10, 12, 14]
    assert ids.where(text.bisect_enabled(F.col("id"), "y")).count() == 16
    assert one(spark, text.bisect_marker(F.lit(255).cast("long"))) == "[bisect-match 0x00000000000000ff]"


def test_markup_and_rendering(spark):
    assert one(spark, text.style(F.lit("*b* and _i_ x_y_z <&"))) == "<b>b</b> and <i>i</i> x_y_z &lt;&amp;"
    assert one(spark, text.inline_links(F.lit("[[http://a][b]] [[c]]"))) == '<a href="http://a">b</a> <a href="c">c</a>'
    assert one(spark, text.unwrap(F.lit("a\nb\n\n\nc"))) == "a b\n\nc"
    assert [one(spark, text.human_list(F.array(*map(F.lit, x)))) for x in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b, and c"]
    assert str(one(spark, text.parse_time(F.lit("2 Jan 2006")))) == "2006-01-02 11:00:00" and one(spark, text.parse_time(F.lit("x"))) is None
    assert one(spark, render.dot_escape(F.lit('a"b\\c\n{<|>}'))) == 'a\\"b\\\\c\\n\\{\\<\\|\\>\\}'
    assert one(spark, text.directives(F.lit("%d %% %-5.2f %[1]s"))) == ["%d", "%-5.2f", "%[1]s"]
    assert one(spark, text.fnv_hash(F.lit("a"))) == 0xAF63DC4C8601EC8C - (1 << 64)
    df = spark.createDataFrame([("a\nb\nc\n", "a\nx\nc\nd\n"), (None, "q"), ("é\nb", "")], "p string, q string")
    e = df.withColumn("e", render.line_edits(F.col("p"), F.col("q")))
    assert all(r["x"] == r["q"] for r in e.select("q", render.apply_edits(F.col("p"), F.col("e")).alias("x")).collect())
    assert "+x" in df.select(render.unified_diff(F.col("p"), F.col("q")).alias("u")).first()["u"]


def test_trees(spark):
    rows = [("f", 0, 9, "File", None, "", 0), ("f", 1, 4, "Func", 0, "Decls", 0), ("f", 2, 2, "Ident", 1, "Name", 0), ("f", 3, 4, "Call", 1, "Body", 0), ("f", 4, 4, "Ident", 3, "Fun", 0), ("f", 5, 9, "Func", 0, "Decls", 1)]
    t = spark.createDataFrame(rows, "file string, pre int, post int, kind string, parent int, edge string, idx int")
    assert [r["pre"] for r in codeindex.of_kinds(t, "Ident").collect()] == [2, 4]
    assert [r["pre"] for r in codeindex.enclosing(t, "f", 4, 4).collect()] == [4, 3, 1, 0]
    assert [r["pre"] for r in codeindex.prune(t, t.where("pre = 1")).orderBy("pre").collect()] == [0, 1, 5]
    assert [r["pre"] for r in codeindex.children(t, "f", 0, "Decls", 1).collect()] == [5]
    sib = {r["pre"]: (r["prev_sibling"], r["next_sibling"]) for r in codeindex.siblings(t).collect()}
    assert sib[1] == (None, 5) and sib[5] == (1, None)


def test_conflicts_and_upserts(spark):
    e = spark.createDataFrame([("f", 0, 4), ("f", 3, 5), ("f", 5, 6)], "g string, start int, end int")
    assert [r["start"] for r in codeindex.interval_conflicts(e, ["g"]).collect()] == [3]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, sets.upsert(rows, rows.limit(1).withColumn("v", F.lit("z")), ["k"]).collect())) == [(1, "z"), (2, "b")]
