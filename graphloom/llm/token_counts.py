"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

One pass lets every task list its most frequent pieces, at most ``SUMMARY`` of
them; the merged list, at most ``FREQUENT`` entries, becomes a compact table
that is broadcast.  The counting pass sums table lengths; a piece that misses
is encoded once per worker and remembered there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import largest, materialise, texts
from .tokens import PieceLengths, in_worker

SUMMARY, FREQUENT, LIMIT, CACHE = 2048, 16384, 512, 500_000


def frequent_pieces(whole: DataFrame, path: str, summary: int = SUMMARY, frequent: int = FREQUENT) -> dict[str, int]:
    """The most frequent pieces of all texts with their token counts.

    It only decides what the first tier holds, never a count, so a task may
    forget rare pieces when its counter outgrows sixteen summaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = PieceLengths(path, cache=0)
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(x for x in lengths.pieces(t.as_py())[0] if len(x) <= 40)
                if len(seen) > 16 * summary:
                    seen = Counter(dict(seen.most_common(4 * summary)))
        top = seen.most_common(summary)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([lengths[p] for p, _ in top], pa.int32())],
            ["piece", "n", "length"],
        )

    lists = whole.select("text").mapInArrow(run, "piece string, n long, length int")
    merged = materialise(lists.groupBy("piece").agg(F.sum("n").alias("n"), F.max("length").alias("length")))
    return {r["piece"]: r["length"] for r in largest(merged, "n", frequent).collect()}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per input row; a null text counts as empty.

    Repeated rows are counted each; special strings in a text count as the
    library's default has them, one token.
    """
    whole = texts(docs, id_col, text_col)
    table = frequent_pieces(whole, path)
    compact = whole.sparkSession.sparkContext.broadcast(("\x00".join(table).encode(), np.fromiter(table.values(), np.uint16, len(table)).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, lens = compact.value
        keys = blob.decode().split("\x00") if blob else []
        tier = dict(zip(keys, np.frombuffer(lens, np.uint16).tolist())) if len(keys) * 2 == len(lens) else {}
        lengths = in_worker("lengths", path, lambda: PieceLengths(path, cache=CACHE)).adopt(tier)
        for b in batches:
            n_bytes, n_tokens = [], []
            for t in b.column(1):
                s = t.as_py()
                n_bytes.append(len(s.encode()))
                n_tokens.append(lengths.count(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return whole.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
