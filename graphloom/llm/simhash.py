"""Near-duplicate detection by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within radius 2 share a variant that differs from each in at
most one bit.  So every distinct fingerprint emits the 65 variants of its
radius-1 ball, one shuffle brings equal variants together, and neighbours in a
bucket are verified and linked.  All members of a bucket lie within the radius
of each other, so the chain through a bucket links exactly what all its pairs
would, and a bucket has at most 65 members whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_split_lookup, materialise, texts
from .components import components

SHINGLE, SEED, BITS = 3, 42, 64
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes) -> int:
    """SimHash of a text: signed 64-bit, bit set if set in over half of the shingle hashes."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    grams = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= SHINGLE else [b" ".join(w)]
    n = max(1, len(w) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    pad = -n % 255
    if pad:
        h = np.concatenate([h, np.zeros(pad, np.uint64)])
    bits = np.empty((8, 8), np.int64)
    for k in range(8):  # byte lanes: a block of 255 rows can't overflow a lane
        lanes = ((h >> np.uint64(k)) & _ONES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        bits[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    over = (bits.reshape(-1) * 2 > n).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, text_key long) per row; null text is empty, without words the fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(1)], ["doc_id", "fp", "text_key"])

    whole = texts(docs, id_col, text_col)
    return whole.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long, text_key long")


def near_links(groups: DataFrame) -> DataFrame:
    """Verified links (a, b), a < b, that connect all distinct ``fp`` within two bits."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS)])
    balls = groups.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    bucket = Window.partitionBy("variant").orderBy("fp")
    pairs = balls.withColumn("a", F.lag("fp").over(bucket)).where("a is not null").select("a", F.col("fp").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def near_components(fps: DataFrame) -> DataFrame:
    """Adds ``component_id`` and ``root``, the least fingerprint of the component, to a materialised (doc_id, fp, text_key) table.

    ``component_id`` is the least doc_id reachable over links of at most two
    bits; null ids are passed over, a component of null ids has a null id.
    """
    groups = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = materialise(components(near_links(groups)).withColumnsRenamed({"node": "fp"}))
    linked = groups.join(roots, "fp").select("fp", "root", "least")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    ids = materialise(ids)
    named_roots = hot_split_lookup(roots, ids, "root", "members", ["fp"]).select("fp", "root", "component_id")
    table = materialise(
        groups.join(named_roots, "fp", "left").select(
            "fp", "n", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
        )
    )
    return hot_split_lookup(fps, table, "fp", "n", ["doc_id", "text_key"]).drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, text_key, component_id, root.

    Nulls, empty and very long texts, repeated ids and empty tables are fine:
    a row is told apart by position only, a null text is an empty one.
    """
    return near_components(materialise(fingerprints(docs, id_col, text_col)))


def one_of_each(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, kept): of each component one row stays, of its least doc_id, the least text_key on ties."""
    is_least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = Window.partitionBy("root").orderBy("text_key")
    least = found.where(is_least).withColumn("kept", F.row_number().over(first) == 1)
    rest = found.where(~is_least).withColumn("kept", F.lit(False))
    return least.unionByName(rest).select("doc_id", "text_key", "kept")
