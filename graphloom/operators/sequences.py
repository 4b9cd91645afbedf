"""Quantifiers and set-like tests over the rows of a frame, and reorderings of small nested values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import map_merge


def first(rows: DataFrame, *order: str) -> DataFrame:
    """The first row by an explicit order; none of an empty frame."""
    return rows.orderBy(*order).limit(1)


def quantified(rows: DataFrame, test: Column) -> DataFrame:
    """One row: every (true of no rows), any (false of no rows), len, empty."""
    t = F.coalesce(test, F.lit(False))
    return rows.agg(
        F.coalesce(F.bool_and(t), F.lit(True)).alias("every"), F.coalesce(F.bool_or(t), F.lit(False)).alias("any"), F.count(F.lit(1)).alias("len"), (F.count(F.lit(1)) == 0).alias("empty")
    )


def contains(rows: DataFrame, column: str, value) -> bool:
    return not rows.where(F.col(column) == value).isEmpty()


def grouped(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key -> rows in order, as an array of structs."""
    s = F.struct(order, *[c for c in rows.columns if c not in (key, order)])
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("rows"))


def arbitrary(m: Column) -> Column:
    """Some entry of a map, null if there is none."""
    return F.get(F.map_entries(m), F.lit(0))


def without(a: Column, value) -> Column:
    return F.array_remove(a, value)


def first_wins(maps: list[Column]) -> Column:
    """Lookup chain: the first map that has a key gives its value."""
    return reduce(lambda rest, m: map_merge(m, rest), reversed(maps[:-1]), maps[-1])


def drop_labels(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))
