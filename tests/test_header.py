from pyspark.sql import functions as F

from graphloom.functions import text


def test_header_in_any_comment_before_code(spark):
    long = "// build comment of a contributor\n" * 3000
    rows = [
        (1, "a.go", long + "// Copyright 2020 The Authors.\n\npackage a\n", False),
        (2, "a.go", long + "\n// Code generated by x. DO NOT EDIT.\npackage a\n", False),
        (3, "a.go", long + "package a\n", True),
        (4, "a.go", "package a\n\n// Copyright 2020\n", True),
        (5, "a.go", "/* long\n" + "x\n" * 3000 + "*/\n\n/* Copyright\n2020 */ package a\n", False),
        (6, "a.py", "#!/usr/bin/python\n" + "#\n" * 2000 + "# Copyright 2020\nimport os\n", False),
        (7, "a.go", "// see a/*\npackage a\n// */ Copyright\n", True),
        (8, "a.txt", "none", False),
        (9, "a.go", "", True),
        (10, "a.go", "var x = 1 // Code generated by x. DO NOT EDIT.\n", True),
    ]
    frame = spark.createDataFrame(rows, "id int, path string, body string, want boolean")
    got = frame.select("id", "want", text.needs_header(F.col("path"), F.col("body"), "Copyright").alias("missing")).collect()
    assert len(got) == len(rows) and [r["id"] for r in got if r["want"] != r["missing"]] == []
