"""Sinks and rankings whose result must not depend on the order of rows."""

from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.streaming import metrics


def test_upsert_sink_hands_on_the_latest_row(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w"), ("b", 1, "v")]
    spark.createDataFrame(rows, "k string, t int, v string").repartition(3).write.parquet(f"{tmp_path}/in")
    got: list[tuple] = []
    stream = spark.readStream.schema("k string, t int, v string").parquet(f"{tmp_path}/in")
    q = metrics.upsert_sink(stream, f"file://{tmp_path}/cp", ["k"], "t", lambda rows, _: got.extend(map(tuple, rows.collect())))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [("a", 3, "y"), ("b", 1, "w")]


def test_rankings_break_ties(spark):
    rows = spark.createDataFrame([("g", 1.0, n) for n in "dbca"], "grp string, score double, name string")
    for n in (1, 3):
        found = [r["name"] for r in search.top_per_group(rows.repartition(n), "grp", "score", 2).orderBy("name").collect()]
        assert found == ["a", "b"]
    files = spark.createDataFrame([("f", True, 2, p) for p in "zyx"], "file string, ws boolean, width int, package string")
    assert search.one_file_each(files.repartition(3), "file", "ws", "width").select(F.col("package")).first()[0] == "x"
