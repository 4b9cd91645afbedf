"""What keeps queries whole on large tables: what is shuffled, what reaches the driver, what is compared."""

from pyspark.sql import functions as F

from graphloom.functions import render
from graphloom.operators import codeindex, compare, dataflow, ordering
from graphloom.plans import catalogue
from graphloom.plans.fixpoint import settle
from graphloom.streaming import metrics


def test_implementing_pairs_are_not_shuffled(spark):
    types = spark.createDataFrame([(i, ["a", "b", "c"] if i % 2 else ["a"]) for i in range(200)], "type long, methods array<string>")
    wanted = [(i, ["a", "b"] if i % 4 == 0 else ["a"]) for i in range(100)] + [(0, ["a"]), (0, ["a", "b"]), (500, []), (501, ["x"])]
    faces = spark.createDataFrame(wanted, "interface long, methods array<string>")
    found = codeindex.implements(types, faces)
    assert found._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"  # pairs come out once without a look at all pairs
    got = sorted((r["type"], r["interface"]) for r in found.collect())
    assert got == [(t, i) for t in range(200) for i in range(100) if t % 2 or i % 4 or i == 0]


def test_types_of_several_rows(spark):
    types = spark.createDataFrame([(1, ["a"]), (1, ["b", "a"]), (2, ["b"])], "type long, methods array<string>")
    faces = spark.createDataFrame([("i", ["a", "a"]), ("i", ["b"]), ("j", ["a", "b"])], "interface string, methods array<string>")
    assert sorted(map(tuple, codeindex.implements(types, faces).collect())) == [(1, "i"), (1, "j"), (2, "i")]


def test_stream_results_stay_out_of_the_driver(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = metrics.read_events(spark, f"{tmp_path}/in", rows.schema)
    by_name = lambda: {t.name for t in spark.catalog.listTables()}
    held = by_name()
    out = metrics.run_once(metrics.sessions(stream, "k", "ts", "2 hours", "1 hour"), f"{tmp_path}/run", "complete", "sessions_of_test")
    assert by_name() == held and len(out.inputFiles()) > 0  # files, no table in the driver's memory
    assert (out.count(), out.agg(F.sum("count")).first()[0]) == (50, 1000)
    in_batches = metrics.counts(metrics.read_events(spark, f"{tmp_path}/in", rows.schema, max_files=1), ["k"], "k")
    assert [r["count"] for r in metrics.run_once(in_batches, f"{tmp_path}/batches", "complete", "batches_of_test").collect()] == [20] * 50
    assert metrics.run_once(stream.where("k < 0"), f"{tmp_path}/none", "append", "nothing_of_test").count() == 0


def test_equal_changes_of_a_name_come_in_parse_order(spark):
    rows = spark.createDataFrame([("a", i, 2.0, 1.0, 0.5, 0.5) for i in reversed(range(9))] + [("b", 0, 1.0, 9.0, 9.0, 1 / 9)], "name string, ord int, before double, after double, ratio double, mag double").coalesce(1)
    assert [(r["name"], r["ord"]) for r in compare.by_delta(rows).collect()] == [("b", 0)] + [("a", i) for i in range(9)]
    assert [r["name"] for r in compare.by_parse_order(rows).collect()][:2] == ["a", "b"]


def test_size_of_settled_rows_is_not_guessed_from_compressed_files(spark, tmp_path):
    spark.range(2_000_000).select((F.col("id") % 9).alias("src"), (F.col("id") % 7).alias("dst")).coalesce(1).write.parquet(f"{tmp_path}/edges")
    read = spark.read.parquet(f"{tmp_path}/edges")
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    edges = settle(read)
    assert size(read) < 10 << 20 < 32_000_000 <= size(edges)  # else they would be broadcast in every round
    assert "Broadcast" not in edges.alias("a").join(edges.alias("b"), F.col("a.src") == F.col("b.dst"))._jdf.queryExecution().sparkPlan().toString()
    assert edges.count() == 2_000_000


def test_postorder_streams_small_graphs(spark):
    pairs = [(f"g{g:03}", n, n + 1) for g in range(40) for n in range(g % 5 + 1)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # graphs go over the ends of batches
    try:
        found = ordering.postorder_of_each(spark.createDataFrame(pairs, "g string, src long, dst long"), "g")
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # a call of Python for each graph
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == sorted((f"g{g:03}", n, g % 5 + 1 - n) for g in range(40) for n in range(g % 5 + 2))


def test_dominators_check_all_pairs_once(spark, monkeypatch):
    pairs = [(0, 1), (0, 6), (1, 2), (2, 3), (3, 4), (4, 5), (6, 2), (6, 7), (7, 8), (8, 5), (4, 1), (5, 9), (9, 9)]
    whole = []
    monkeypatch.setattr(dataflow, "settle", lambda df: whole.append(sorted(df.columns)) or settle(df))
    found = dataflow.dominators(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,)], "id long"))
    assert whole.count(["dominator", "id"]) == 1  # not the whole table in every round

    def reach(without):
        seen, todo = set(), [0] if without else []
        while todo:
            n = todo.pop()
            if n not in seen and n != without:
                seen.add(n)
                todo += [b for a, b in pairs if a == n]
        return seen

    assert sorted(map(tuple, found.collect())) == sorted((n, d) for n in range(10) for d in range(10) if n == d or n not in reach(d))


def test_round_trip_keeps_no_edits(spark):
    rows = spark.createDataFrame([("a\nb\nc\n", "a\nx\nc\n"), ("", "é\n"), ("ü\nz", "ü\nz"), (None, "q"), ("q", None)], "a string, b string").select("a", "b", render.round_trip(F.col("a"), F.col("b")).alias("r"))
    assert [(r["r"]["n"], r["r"]["ok"]) for r in rows.collect()] == [(1, True), (1, True), (0, True), (1, True), (1, None)]
    plan = catalogue.QUERIES["diff_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "new:string" not in plan and plan.count("ArrowEvalPython") == 1  # edits of a batch aren't sent back and forth
