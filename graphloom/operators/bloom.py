"""Bloom filters over a column: built with one aggregation, probed without a shuffle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizes(n: int, false_positive: float = 0.05) -> tuple[int, int]:
    """(bytes, hashes): m = -n ln p / ln² 2 bits rounded up to bytes, k = round(-ln p / ln 2), at least one each."""
    if n <= 0:
        return 1, 1
    bits = -n * math.log(false_positive) / math.log(2) ** 2
    return max(1, math.ceil(bits / 8)), max(1, round(-math.log(false_positive) / math.log(2)))


class BloomFilter:
    """No false negatives; about ``false_positive`` of what is not held passes.

    The bits come back as at most m / 64 words, so ``n`` bounds what is
    collected; build filters over more keys than fit a driver by partition.
    """

    def __init__(self, rows: DataFrame, column: str, false_positive: float = 0.05, n: int | None = None):
        self.bytes, self.hashes = sizes(n if n is not None else rows.count(), false_positive)
        bits = self.bytes * 8
        at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(column).cast("string")), F.lit(bits)) for k in range(self.hashes)])).alias("bit")
        word = rows.where(F.col(column).isNotNull()).select(at).groupBy(F.floor(F.col("bit") / 64).alias("word"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
        self.words = np.zeros(-(-bits // 64), np.int64)
        for r in word.agg(F.bit_or(one).alias("bits")).collect():
            self.words[r["word"]] = r["bits"]

    def may_contain(self, value: Column) -> Column:
        words, bits = self.words, self.bytes * 8
        positions = F.array(*[F.pmod(F.xxhash64(F.lit(k), value.cast("string")), F.lit(bits)) for k in range(self.hashes)])

        def test(found: pd.Series) -> pd.Series:
            if not len(found):
                return pd.Series([], dtype=bool)
            p = np.stack(found.to_numpy())
            return pd.Series((words[p >> 6] >> (p & 63) & 1).all(axis=1))

        return F.pandas_udf(test, "boolean")(positions)
