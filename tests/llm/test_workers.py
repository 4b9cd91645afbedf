"""Operators run where the executors have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
RUN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def here(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("graphloom") is not None])], ["x"])
assert not any(r[0] for r in spark.range(1).mapInArrow(here, "x boolean").collect())
from graphloom.llm import queries
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["op1_lm_scores"], ["op7_toxicity"], ["op4_token_counts", "op5_best_fit_packing", "op8_exact_dedup"]])
def test_without_the_package_on_workers(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", RUN.format(repo=str(REPO), names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-2000:]
    assert [line.split()[0] for line in got.stdout.splitlines()] == names
