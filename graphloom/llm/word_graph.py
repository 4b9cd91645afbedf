"""The PPMI graph of all frequent words, and restarting walks over it.

Every two nodes that occur within a window of each other somewhere are counted.
Pairs are not shuffled: documents are coded once as numbers of nodes, and each
task reads the codes of all documents and counts the pairs of a block of rows,
in an array of all cells, or by sorting where the rows' words are so rare that
the pairs take less room than the cells.  A pair belongs to the row of its rarer word.  Only pairs that occur
more often than chance are edges; they stay in the shared folder, compressed,
and each step towards the walks' visits is a pass over them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, materialise, shared_dir, summed_arrays
from .tokens import in_worker

#: Words in a row of codes; bytes of a block's counts, and occurrences of its words (or this part of all); tasks of a step.
SCAN, BYTES, OCCURRENCES, PART_OF_ALL, PARTS = 1_000_000, 128_000_000, 2_000_000, 24, 12
#: Bytes of a pair's place where pairs are sorted; cells looked at together; edges in a row of edges, about, and cells below 2**32.
PLACE, SLICE, EDGES_AT_ONCE, FAR = 16, 2_000_000, 500_000, 2**31
#: The quicker one for codes, which every block reads; the smaller one for edges.
CODECS = ("lz4_raw", "zstd")
#: The walks have settled when a step moves less than this share of all visits.
MOVED = 1e-5


@contextmanager
def wide_rows(spark: SparkSession, rows: int = 4):
    """Few rows in a batch for Python and from Parquet, as each holds megabytes."""
    arrow, parquet = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(parquet)
    spark.conf.set(arrow, str(rows))
    spark.conf.set(parquet, str(rows))
    try:
        yield
    finally:
        spark.conf.set(arrow, str(BATCH_ROWS))
        spark.conf.set(parquet, before)


@contextmanager
def kept_codes(spark: SparkSession):
    """A folder for codes in the shared folder, removed in the end."""
    path = f"{shared_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def packed(x: np.ndarray, codec: int = 0) -> bytes:
    """Numbers below 2**32, compressed byte place by byte place, after the number of places that are needed and that of the codec."""
    x = x.astype("<u4")
    k = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    places = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T[:k])
    return bytes([k, codec]) + pa.compress(places.tobytes(), CODECS[codec], asbytes=True)


def unpacked(blob: pa.Scalar, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    held = blob.as_buffer()
    k, codec = held.slice(0, 2).to_pybytes()
    places = np.frombuffer(pa.decompress(held.slice(2), k * n, CODECS[codec]), np.uint8).reshape(k, n)
    out = places[0].astype(np.uint32)
    for j in range(1, k):
        out |= places[j].astype(np.uint32) << np.uint32(8 * j)
    return out


def cells(row):
    """Cells of the rows before ``row``: a row has one for each node before its own."""
    return row * (row - 1) // 2


def coded(docs: DataFrame, values: Callable, size: int, window: int, path: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((n, codes) of all documents; by node its occurrences; by node the places within windows of it, and at the end those of all words).

    ``values()`` makes what codes texts: node, or -1 for another word.  Codes are stored in ``path``, 2 higher, a 0 being the gap between documents.
    """
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, gap = in_worker("toxicity nodes", name, values), np.full(window, -2, np.int32)
        sums, part, held, waiting = np.zeros(2 * size + 1), None, [gap], 0

        def row(n: int, codes: bytes | None, total: bytes | None) -> pa.RecordBatch:
            cols = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([codes], pa.binary()), pa.array([total], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "n", "codes", "sums"])

        def counted() -> pa.RecordBatch:
            x = np.concatenate(held)
            held[1:] = []
            word = x != -2
            upto, at = np.concatenate([[0], np.cumsum(word)]), np.flatnonzero(word)
            places = upto[at + window + 1] - upto[at - window] - 1
            sums[-1] += places.sum()
            some = x[at] >= 0
            node = x[at[some]]
            sums[:size] += np.bincount(node, minlength=size)
            sums[size:-1] += np.bincount(node, places[some], size)
            return row(len(x), packed(x + 2), None)

        for b in batches:
            part = b.column(1)[0].as_py() if b.num_rows else part
            for x in found.of_all(b.column(0).to_pylist()):
                held += [x, gap]
                waiting += len(x) + window
                if waiting > SCAN:
                    yield counted()
                    waiting = 0
        if part is not None:
            yield counted()
            yield row(0, None, sums.tobytes())

    each = docs.select("text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, "part long, n long, codes binary, sums binary")
    each.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(path)
    with wide_rows(docs.sparkSession):
        held = docs.sparkSession.read.parquet(path)
        sums = summed_arrays(held.where("sums IS NOT NULL").select("part", "sums"))
    sums = np.zeros(2 * size + 1) if sums is None else sums
    return held.where("n > 0").select("n", "codes"), sums[:size], sums[size:]


def kind(most: float, window: int) -> type:
    """Of the counts in rows whose words occur ``most`` times at most."""
    return np.uint16 if most * 2 * window < 2**16 else np.uint32


def blocks(occurrences: np.ndarray, window: int, at_once: int) -> list[tuple[int, int, type | None]]:
    """(first row, row after the last, kind of the counts or None where pairs are sorted) of blocks with bounded bytes, occurrences and rows, of one row at least."""
    limit, out, low, seen, most = max(OCCURRENCES, occurrences.sum() / PART_OF_ALL), [], 0, 0.0, 0.0

    def sizes(high: int) -> tuple[float, float]:
        return (cells(high) - cells(low)) * np.dtype(kind(most, window)).itemsize, PLACE * 2 * window * seen

    def block(high: int) -> tuple[int, int, type | None]:
        table, pairs = sizes(high)
        return low, high, kind(most, window) if table <= pairs else None

    for a, n in enumerate(occurrences.tolist()):
        before, (seen, most) = (seen, most), (seen + n, max(most, n))
        if a > low and (min(sizes(a + 1)) > BYTES or seen > limit or a - low >= at_once):
            seen, most = before
            out.append(block(a))
            low, seen, most = a, n, n
    return [*out, block(len(occurrences))] if len(occurrences) else []


EDGES = "low long, high long, n long, lengths binary, steps binary, counts binary"


def graph(codes: DataFrame, occurrences: np.ndarray, places: np.ndarray, window: int, at_once: int) -> DataFrame:
    """The edges: of rows from ``low`` to ``high`` how many each has, steps from cell to cell, and counts of the pairs."""
    spark, cuts = codes.sparkSession, blocks(occurrences, window, at_once)
    shared = spark.sparkContext.broadcast((places, [(*x, 2 * window * int(occurrences[x[0] : x[1]].sum())) for x in cuts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (slots, of), two = shared.value, np.uint32(2)
        table, filled, low, high, width = None, 0, 0, 0, None
        for b in batches:  # of one block
            if table is None and b.num_rows:
                low, high, width, pairs = of[b.column(2)[0].as_py()]
                table = np.empty(pairs, np.int64) if width is None else np.zeros(cells(high) - cells(low), width)
            for n, c in zip(b.column(0).to_pylist(), b.column(1)):
                if n <= 2 * window:  # a gap only
                    continue
                x = unpacked(c, n)
                of_block, around = np.flatnonzero(x - np.uint32(low + 2) < np.uint32(high - low)), sliding_window_view(x, 2 * window + 1)
                for k in range(0, len(of_block), 4000):
                    at = of_block[k : k + 4000]
                    row, near = x[at] - two, around[at - window] - two
                    ok = near < row[:, None]  # other words and gaps are above all
                    cell = near[ok] + np.repeat(cells(row.astype(np.int64)) - cells(low), np.count_nonzero(ok, axis=1))
                    if width is None:
                        table[filled : filled + len(cell)] = cell
                        filled += len(cell)
                    else:
                        np.add.at(table, cell, width(1))
        if table is None:
            return
        keys = counts = np.zeros(0, np.int64)
        if width is None and filled:
            table = table[:filled]
            table.sort()
            other = np.ones(filled, bool)
            np.not_equal(table[1:], table[:-1], out=other[1:])
            first = np.flatnonzero(other)
            keys, table = table[first], None
            counts = np.diff(first, append=filled)
        a, begun, held = low, low, []
        while a < high:
            top = min(high, max(a + 1, int((1 + math.sqrt(1 + 8 * (cells(a) + SLICE))) / 2)))
            begin = cells(np.arange(a, top + 1)) - cells(low)
            if width is None:
                some = slice(*np.searchsorted(keys, begin[[0, -1]]))
                key, n = keys[some], counts[some]
            else:
                cut = table[begin[0] : begin[-1]]
                key = np.flatnonzero(cut)
                n = cut[key]
                key += begin[0]
            lengths = np.diff(np.searchsorted(key, begin))
            row, n = np.repeat(np.arange(a, top), lengths), n.astype(float)
            more = n * slots[-1] > slots[row] * slots[key - np.repeat(begin[:-1], lengths)]
            held.append((row[more], key[more], n[more]))
            a = top
            if a == high or sum(len(x[1]) for x in held) >= EDGES_AT_ONCE or cells(a) - cells(begun) > FAR:
                row, key, n = (np.concatenate(x) for x in zip(*held))
                blobs = (np.bincount(row - begun, minlength=a - begun), np.diff(key, prepend=cells(begun) - cells(low)), n)
                cols = [pa.array([int(v)], pa.int64()) for v in (begun, a, len(key))] + [pa.array([packed(v, 1)], pa.binary()) for v in blobs]
                if len(key):
                    yield pa.RecordBatch.from_arrays(cols, ["low", "high", "n", "lengths", "steps", "counts"])
                begun, held = a, []

    with wide_rows(spark):
        each = spark.range(0, len(cuts), 1, max(1, len(cuts))).withColumnRenamed("id", "block")
        return materialise(codes.coalesce(1).join(each.hint("shuffle_replicate_nl")).mapInArrow(run, EDGES))  # a task for each block


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of at most ``PARTS`` arrays."""
    total = None
    for b in batches:
        for x in b.column(0):
            more = np.frombuffer(x.as_buffer(), float)
            total = more if total is None else total + more
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def spread(edges: DataFrame, places: np.ndarray, damping: float, u: np.ndarray) -> np.ndarray:
    """Weights of the edges times each row of ``u``; a weight is a pair's positive PMI, damped where it rests on few places."""
    shared, (k, size) = edges.sparkSession.sparkContext.broadcast((places, u)), u.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (slots, u), sums, part = shared.value, np.zeros((k, size)), None
        log, few = np.log(np.maximum(slots, 1e-9)), np.arange(4096)
        log_few, damped_few = np.log(np.maximum(few, 1)), few / (few + damping)
        for b in batches:
            for i in range(b.num_rows):
                part, low, high, n = (b.column(j)[i].as_py() for j in (6, 0, 1, 2))
                rows = np.arange(low, high)
                lengths = unpacked(b.column(3)[i], high - low)
                key = np.cumsum(unpacked(b.column(4)[i], n), dtype=np.int64)
                col = key - np.repeat(cells(rows) - cells(low), lengths)
                count = unpacked(b.column(5)[i], n)
                many = np.flatnonzero(count > 4095)
                small = np.minimum(count, 4095)
                w, damped = log_few[small], damped_few[small]
                w[many], damped[many] = np.log(count[many]), count[many] / (count[many] + damping)
                w += np.repeat(log[-1] - log[low:high], lengths)
                w -= log[col]
                w *= damped
                some = np.flatnonzero(lengths)
                begin = (np.cumsum(lengths, dtype=np.int64) - lengths)[some]
                for out, v in zip(sums, u):
                    out[:high] += np.bincount(col, w * np.repeat(v[low:high], lengths), high)
                    out[low + some] += np.add.reduceat(w * v[col], begin)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    with wide_rows(edges.sparkSession):
        numbered = edges.coalesce(PARTS).withColumn("part", F.spark_partition_id().cast("long"))
        parts = numbered.mapInArrow(run, "part long, sums binary").repartition(1).sortWithinPartitions("part")
        sums = parts.select("sums").mapInArrow(added, "sums binary").collect()  # one row
    return np.frombuffer(sums[0]["sums"], float).reshape(k, size) if sums else np.zeros((k, size))


def walks(edges: DataFrame, places: np.ndarray, damping: float, starts: np.ndarray, restart: float) -> np.ndarray:
    """Share of visits of each node by the walks that restart at each row of ``starts``."""
    out = spread(edges, places, damping, np.ones((1, starts.shape[1])))[0]
    start = starts / np.maximum(starts.sum(axis=1, keepdims=True), 1e-12)
    root = np.sqrt(np.maximum(out, 0))
    part = np.divide(1, root, out=np.zeros_like(root), where=root > 0)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)[:, None]
    # visits times ``part`` solve a symmetric system, whose residual times ``root`` is what a step of the walk would move: conjugate gradients
    x = restart * start * part
    left = (1 - restart) * part * spread(edges, places, damping, x * part)
    along, length = left, (left**2).sum(axis=1)
    while np.abs(left * root).sum(axis=1).max() > MOVED:
        ahead = along - (1 - restart) * part * spread(edges, places, damping, along * part)
        far = ratio(length, (along * ahead).sum(axis=1))
        x, left = x + far * along, left - far * ahead
        before, length = length, (left**2).sum(axis=1)
        along = left + ratio(length, before) * along
    return np.where(root > 0, x * root, restart * start)
