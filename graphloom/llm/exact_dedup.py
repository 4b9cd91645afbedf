"""Exact deduplication that takes heavy-hitting texts out of the shuffle.

A Misra-Gries pass over the digests finds every text that holds more than about
``2 / counters`` of all rows.  Their exact winners are computed with map-side
combining and broadcast (at most ``counters`` rows), so copies of a hot text
are removed where they are read.  All other digests go through one ordinary
shuffle, in which no group can hold more than that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import largest, materialise, texts

COUNTERS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, text_key): SHA-256 of the text with A-Z lower-cased; null text is empty."""

    whole = texts(docs, id_col, text_col)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return whole.select("doc_id", F.unhex(F.sha2(low.cast("binary"), 256)).alias("digest"), F.xxhash64("text").alias("text_key"))


def _shrink(counts: Counter, counters: int) -> Counter:
    """Subtract the (counters + 1)-th count from all; what stays positive stays."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent_digests(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The digests on more than about ``2 / counters`` of the rows, and some others, at most ``counters``.

    Every task keeps ``counters`` Misra-Gries counters, each at most
    ``rows / counters`` too low; summaries are added up, and the largest sums
    stay.  What they miss is only slower, never wrong.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            held.update(b.column(0).to_pylist())
            held = _shrink(held, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])

    merged = materialise(keyed.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1"))
    return materialise(largest(merged, "n", counters).select("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, digest, text_key, keep_id, group_size, kept.

    The largest id of equal texts stays.  Null text counts as empty; null ids
    sort last, and a group with null ids only has a null ``keep_id`` and keeps
    one row.  Of rows equal in text and id, exactly one stays.
    """
    keyed = materialise(digests(docs, id_col, text_col))
    return decide(keyed, counters)


def decide(keyed: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``exact_dedup`` over a computed (doc_id, digest, ...) table; further columns pass through."""
    hot = frequent_digests(keyed, counters)
    winners = materialise(
        keyed.select("doc_id", "digest")
        .join(F.broadcast(hot), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    wins = F.broadcast(winners)
    rest = keyed.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    first = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id"))
    cold = rest.withColumns({"keep_id": F.max("doc_id").over(group), "group_size": F.count(F.lit(1)).over(group), "kept": F.row_number().over(first) == 1})
    copies = keyed.join(wins, "digest")
    is_top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    lost = copies.where(~is_top).withColumn("kept", F.lit(False))
    top = copies.where(is_top).withColumn("kept", F.row_number().over(first) == 1)
    return cold.unionByName(lost).unionByName(top)
