"""Best-fit packing in bulk-synchronous rounds over run-length coded orders.

Lengths are whole numbers up to the sequence length L, so the range-sorted
order of the documents is at most L runs of equal lengths and that of the gaps
at most L runs of equal gaps.  The distributed part counts the runs, ranks every
piece inside its run (hot lengths are split over tasks) and, at the end, maps
ranks to places.  A round takes one run of lengths, longest first, and sweeps
the gap runs for successors: the least gap that fits is taken, pieces and gaps
that compete are matched by rank, the gaps are updated, and the sweep repeats
until the run is placed; what finds no gap opens sequences.  A round costs at
most L steps however many documents a run holds, which is why the sweep itself
runs where the L counts are; the result is that of best fit decreasing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, texts
from .tokens import WordIds, in_worker

#: Tokens of a sequence; rows of one length that one task may rank.
LENGTH, RUN_ROWS = 2048, 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LENGTH, end: int = 0) -> DataFrame:
    """Every document as ids plus ``end``, cut into pieces of ``limit`` where longer."""
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = in_worker("ids", path, lambda: WordIds(path))
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.ids(t.as_py()) + tail
                for k in range(0, len(ids), 4 * limit):
                    part = ids[k : k + 4 * limit]
                    for col, v in zip(cols, (i, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def best_fit_rounds(counts: dict[int, int], limit: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Places for runs of pieces: (length, first rank, first sequence, offset).

    Ranks from there up to the next entry of that length go to consecutive
    sequences, all at that offset.
    """
    places: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, how many)
    held = np.zeros(limit + 1, np.int64)  # gap -> runs
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if n and gap:
            gaps[gap].append((first, n))
            held[gap] += 1

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            fits = np.flatnonzero(held[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, n = gaps[gap].pop()
                held[gap] -= 1
            else:
                gap, first = limit, opened
                n = -(-(total - rank) // (limit // length))
                opened += n
            layers = gap // length
            full = min(n, (total - rank) // layers)
            for k in range(layers if full else 0):
                places.append((length, rank, first, limit - gap + k * length))
                rank += full
            put(gap - layers * length, first, full)
            rest = total - rank
            if full < n and rest:  # fewer than a sequence takes: they share the next one
                for k in range(rest):
                    places.append((length, rank, first + full, limit - gap + k * length))
                    rank += 1
                put(gap - rest * length, first + full, 1)
                full += 1
            put(gap, first + full, n - full)
    return places


def pack(parts: DataFrame, limit: int = LENGTH, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces with a ``length`` of 1 to ``limit``.

    A length of more than ``run_rows`` pieces is ranked by as many tasks as it
    needs, so the counts that reach the driver number at most ``limit`` plus
    one for every ``run_rows`` pieces.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    hot = [(n, -(-c // run_rows)) for n, c in counts.items() if c > run_rows]
    most = max((k for _, k in hot), default=1)
    salts = parts.sparkSession.createDataFrame(hot, "length long, __salts int")
    salted = parts.join(F.broadcast(salts), "length", "left").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    base = np.zeros((limit + 1, most), np.int64)
    if hot:
        for r in salted.join(F.broadcast(salts), "length", "left_semi").groupBy("length", "__salt").count().collect():
            base[r["length"], r["__salt"]] = r["count"]
        base = np.cumsum(base, axis=1) - base
    plan = sorted(best_fit_rounds(counts, limit))
    keys = np.array([(p[0] << 44) + p[1] for p in plan], np.int64)
    shared = parts.sparkSession.sparkContext.broadcast((base, keys, np.array([p[1:] for p in plan], np.int64).reshape(-1, 3)))
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, keys, plan = shared.value
        for b in batches:
            length, salt, local = (b.column(c).to_numpy() for c in ("length", "__salt", "__rank"))
            rank = base[length, salt] + local - 1
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            first = plan[at]
            seq, off = first[:, 1] + rank - first[:, 0], first[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return salted.withColumn("__rank", F.row_number().over(order).cast("long")).mapInArrow(run, schema)


def best_fit_packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece, the end id alone.  Rows are packed each,
    ids that are null or repeat included; an empty table gives none.
    """
    return pack(materialise(pieces(docs, path, id_col, text_col, limit)), limit)
