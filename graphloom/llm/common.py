"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of decision keys that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 300_000
#: Rows of texts in one batch for Python; a batch is held in the JVM and in the worker.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs on one machine (tests, a laptop)
    a folder is made; on a cluster that would be another one for each executor.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, into the shared folder, and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def named(col: str) -> Column:
    return F.col("`" + col.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty, whatever else the table holds.

    Batches that go to Python are kept to ``BATCH_ROWS`` rows, as texts are wide.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(
        named(id_col).cast("long").alias("doc_id"),
        F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"),
    )


def text_key(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(named(text_col).cast("string"), F.lit("")))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised side whose counted rows are within the bound.

    Beyond the bound the plain frame goes back, and the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def largest(df: DataFrame, by: str, most: int, per_octave: int = 16) -> DataFrame:
    """The rows of largest ``by``, at most ``most`` of them, by a cut from a histogram of powers.

    An ordered limit would send ``most`` rows of every partition to the driver;
    the histogram has a bounded number of rows however many partitions there
    are.  Rows of one bucket stay or go together; values up to 0 go.
    """
    bucket = F.floor(F.log2(F.col(by).cast("double")) * per_octave)
    counts = df.where(F.col(by) > 0).groupBy(bucket.alias("b")).count().collect()
    cut, total = None, 0
    for r in sorted(counts, key=lambda r: -r["b"]):
        total += r["count"]
        if total > most:
            break
        cut = r["b"]
    return df.limit(0) if cut is None else df.where((F.col(by) > 0) & (bucket >= cut))


def summed_arrays(parts: DataFrame, at_once: int = 16) -> np.ndarray | None:
    """Element-wise sum of ``sums`` (64-bit floats as bytes, all of one length) over ``(part, sums)``; None of no rows.

    Parts are unique.  They are added up in order of ``part`` in levels of
    ``at_once`` arrays a task, so no task and not the driver meets more than
    that many, and the sum doesn't depend on how the rows are partitioned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(0)
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                more = np.frombuffer(x.as_buffer(), float)
                if p != part and part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])
                total = more if p != part else total + more
                part = p
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    held = materialise(parts)
    most = held.agg(F.max("part")).first()[0]
    while most is not None:
        groups = most // at_once + 1
        order = held.select(F.floor(F.col("part") / at_once).alias("__group"), "part", "sums").repartition(groups, "__group").sortWithinPartitions("__group", "part")
        held = order.select(F.col("__group").alias("part"), "sums").mapInArrow(run, "part long, sums binary")
        if groups == 1:
            return np.frombuffer(held.first()["sums"], float)
        held, most = materialise(held), groups - 1
    return None


def hot_split_lookup(
    left: DataFrame, right: DataFrame, key: str, n_col: str, spread: list[str], share: float = 1e-3, salts: int = 32
) -> DataFrame:
    """Left join to ``right`` (unique on ``key``, ``n_col`` = rows of that key on the left).

    A key with over ``share`` of all rows is split over ``salts`` tasks.  At
    most ``1 / share`` keys can be that frequent, so their list may be broadcast.
    """
    total = right.agg(F.sum(n_col)).first()[0] or 0
    hot = right.where(F.col(n_col) > F.lit(max(1, int(total * share)))).select(key, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_left = left.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__hot")
    salted_right = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("__hot")
    )
    return salted_left.join(salted_right, [key, "__salt"], "left").drop("__salt")


def keep_decided(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``decisions (doc_id, text_key, kept)`` keeps, all columns unchanged.

    Rows are told apart by id and text; null ids match null.  Of rows equal in
    both, as many stay as were decided to.
    """
    per = materialise(
        decisions.groupBy("doc_id", "text_key")
        .agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col("kept").cast("long")).alias("__k"))
        .where(F.col("__k") < F.col("__n"))
        .withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    )
    keyed = docs.withColumns({"__gl_id": named(id_col).cast("long"), "__gl_key": text_key(text_col)})
    same = lambda d: keyed_id.eqNullSafe(d["__id"]) & (keyed_key == d["__key"])
    keyed_id, keyed_key = F.col("__gl_id"), F.col("__gl_key")
    drop, tied = per.where("__k = 0"), per.where("__k > 0")
    kept = keyed.join(broadcast_if_small(drop), same(drop), "left_anti")
    if not tied.isEmpty():
        from pyspark.sql import Window

        some = broadcast_if_small(tied)
        order = Window.partitionBy("__gl_id", "__gl_key").orderBy(F.lit(0))
        extra = (
            kept.join(some, same(tied), "inner").withColumn("__rn", F.row_number().over(order)).where("__rn <= __k").select(*kept.columns)
        )
        kept = kept.join(some, same(tied), "left_anti").unionByName(extra)
    return kept.drop("__gl_id", "__gl_key")
