"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask says which words count; words with substitutions under the mask's gaps
hash the same.  The masks are so short that no stretch with enough equal words
is without a place where one of them lies on equal words only.  Every position
of every document is hashed under each mask and only where the hash is some
item's too is it joined with the items; there the words around are compared,
over all stretches that contain the hit.
The index of the benchmark is broadcast in blocks of a fixed number of rows, so
the documents are never shuffled, however large the benchmark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep_decided, materialise, named, texts

#: Four words each, so that one expression hashes under any of them; five words of which one is changed need the short ones too.
MASKS, SHORT_MASKS = ("1111", "11011"), ("11101", "10111")
#: Words compared around a hit, share of them that must be equal, least item length, index rows in one broadcast.
WINDOW, SIMILARITY, SHORTEST, BLOCK_ROWS = 15, 0.8, 5, 100_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; may begin or end with an empty word."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def masks_for(items: DataFrame) -> list[str]:
    """The masks that find every item with as many words changed as may be."""
    return [*MASKS, *SHORT_MASKS] if items.where(F.size("w") <= max(map(len, SHORT_MASKS))).limit(1).count() else list(MASKS)


def _hash(masks: list[str], w: Column, i: Column, mask: Column) -> Column:
    """Hash of the words under the ``mask``-th mask at position ``i``; null where it doesn't fit."""

    def of_mask(values: list[int]) -> Column:
        each = F.lit(values[0])
        for m, v in enumerate(values[1:], 1):
            each = F.when(mask == m, v).otherwise(each)
        return each if len(set(values)) > 1 else F.lit(values[0])

    care = list(zip(*[[k for k, c in enumerate(m) if c == "1"] for m in masks]))
    return F.when(i + of_mask([len(m) for m in masks]) <= F.size(w), F.xxhash64(mask, *[F.get(w, i + of_mask(list(k))) for k in care]))


def _places(masks: list[str], w: Column) -> Column:
    """Numbers that stand for each position with each mask."""
    last = F.size(w) - min(map(len, masks))
    return F.when(last >= 0, F.sequence(F.lit(0), (last + 1) * len(masks) - 1))


def benchmark_index(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """(hash, lead, around, item_id): the words of all stretches of ``window`` words that hold the hit, ``lead`` words behind their start.

    Of an item that is shorter the words are the whole item.  Equal words of
    several items are one row, under the least item.
    """
    items = benchmark.select(named(item_col).cast("long").alias("item_id"), words(F.coalesce(named(text_col).cast("string"), F.lit(""))).alias("w"))
    items = materialise(items.select("item_id", F.filter("w", lambda x: x != "").alias("w")).where(F.size("w") >= SHORTEST))
    masks = masks_for(items)
    w, n, place = F.col("w"), F.size("w"), F.col("place")
    i, mask = F.floor(place / len(masks)).cast("int"), (place % len(masks)).cast("int")
    at = items.select("*", F.explode(_places(masks, w)).alias("place")).select("item_id", "w", i.alias("i"), mask.alias("mask"))
    needed = (F.col("mask") < len(MASKS)) | (n <= max(map(len, SHORT_MASKS)))
    hit = at.where(needed).withColumn("hash", _hash(masks, w, F.col("i"), F.col("mask"))).where("hash is not null")
    span, size = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1), F.least(n, F.lit(window))
    start = F.greatest(F.lit(0), F.col("i") + span - size)
    rows = hit.select("item_id", "hash", (F.col("i") - start).alias("lead"), F.slice("w", start + 1, F.least(n, F.col("i") + size) - start).alias("around"))
    return materialise(rows.groupBy("hash", "lead", "around").agg(F.min("item_id").alias("item_id"))), masks


def _overlap(w: Column, first: Column, around: Column, window: int = WINDOW) -> Column:
    """Largest share of equal words over the stretches of ``around``, whose start lies at ``first`` in ``w``."""
    size = F.least(F.size(around), F.lit(window))
    bit = lambda k: F.when(F.get(w, first + k) == F.get(around, k), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    equal = F.aggregate(F.sequence(F.lit(0), F.size(around) - 1), F.lit(0).cast("long"), lambda bits, k: bits + bit(k))
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1
    # the bits are handed in as an array of one, so that they are worked out once and not per stretch
    each = F.transform(F.array(equal), lambda bits: F.array_max(F.transform(F.sequence(F.lit(0), F.size(around) - size), lambda s: F.bit_count(F.call_function("shiftright", bits, s).bitwiseAND(ones)))))
    return F.get(each, F.lit(0)) / size


def contaminated(docs: DataFrame, index: DataFrame, masks: list[str], similarity: float = SIMILARITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, text_key, item_id, overlap) for the rows of ``docs (doc_id, text)`` with a verified hit."""
    w, i, place = F.col("w"), F.col("i"), F.col("place")
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    placed = split.select("*", F.explode_outer(_places(masks, w)).alias("place"))
    numbered = placed.select("*", F.floor(place / len(masks)).cast("int").alias("i"), (place % len(masks)).cast("int").alias("mask"))
    hashed = numbered.select("doc_id", "text_key", "w", "i", _hash(masks, w, i, F.col("mask")).alias("hash"))
    # the words that a stretch around the hit can reach, and where in them the hit is
    near = F.slice(w, F.greatest(i - WINDOW, F.lit(0)) + 1, 2 * WINDOW)
    at = F.least(i, F.lit(WINDOW))
    found = []
    blocks = max(1, math.ceil(index.count() / block_rows))
    for b in range(blocks):
        block = index.where(F.pmod(F.col("hash"), F.lit(blocks)) == b) if blocks > 1 else index
        seeds = block.select("hash").distinct()
        # the wide array ends here, in generated code, before anything copies it per position
        some = hashed.join(F.broadcast(seeds), "hash", "left_semi").select("doc_id", "text_key", "hash", near.alias("w"), at.alias("i"))
        hits = some.join(F.broadcast(block), "hash")
        found.append(hits.select("doc_id", "text_key", "item_id", _overlap(w, i - F.col("lead"), F.col("around")).alias("overlap")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.where(F.col("overlap") >= similarity).groupBy("doc_id", "text_key")
    return best.agg(F.min("item_id").alias("item_id"), F.max("overlap").alias("overlap"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    index, masks = benchmark_index(benchmark)
    return materialise(contaminated(texts(docs, id_col, text_col), index, masks))


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, contaminated, item_id (the least that overlaps), overlap.

    Null texts are empty and clean, as are all with an empty benchmark; items
    of under five words are too short to be evidence and are passed over.
    Rows that repeat get the same answer each; null ids match null ids.
    """
    hits = find(docs, benchmark, id_col, text_col).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"))
    joined = rows.join(broadcast_if_small(hits), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    return joined.select("doc_id", F.col("__key").isNotNull().alias("contaminated"), "item_id", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns unchanged."""
    hits = find(docs, benchmark, id_col, text_col)
    return keep_decided(docs, hits.select("doc_id", "text_key", F.lit(False).alias("kept")), id_col, text_col)
