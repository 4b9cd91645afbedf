"""Fixed-point loops over DataFrames: lineage is cut in the shared checkpoint folder every round."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast after it has been counted.
BROADCAST_ROWS = 300_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; set one only where none is set, as on a laptop."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured and sc.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="graphloom-"))


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; survives lost executors, as the folder is shared.

    The rows come back without an estimate of their size: a checkpoint keeps
    that of its plan, taken from compressed files, and with it Spark would
    broadcast millions of edges in every round.  Joins are decided by the
    sizes met at run time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a settled frame within the row bound, else the frame as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def grow(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], limit: int | None = None) -> DataFrame:
    """Semi-naive iteration: rows that ``step`` derives from the newest rows and whose keys are new.

    ``start`` has distinct keys.  Ends when a round brings nothing new, or after
    ``limit`` rounds.
    """
    known = newest = settle(start)
    round_ = 0
    while not newest.isEmpty() and (limit is None or round_ < limit):
        round_ += 1
        newest = settle(step(newest, round_).join(known.select(keys), keys, "left_anti"))
        known = settle(known.unionByName(newest)) if round_ % 8 == 0 else known.unionByName(newest)
    return known
