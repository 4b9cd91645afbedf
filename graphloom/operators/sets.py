"""Integer sets as rows ``(v)``, maps as columns, and runs of consecutive values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def union(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y).distinct()


def intersection(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.intersect(y)


def difference(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.subtract(y)


def symmetric_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    """Values on just one side, by one shuffle of both."""
    tagged = x.distinct().withColumn("__x", F.lit(1)).unionByName(y.distinct().withColumn("__x", F.lit(2)))
    return tagged.groupBy("v").agg(F.sum("__x").alias("s")).where("s < 3").select("v")


def insert(x: DataFrame, value) -> DataFrame:
    return union(x, x.sparkSession.range(1).select(F.lit(value).cast(x.schema["v"].dataType).alias("v")))


def remove(x: DataFrame, value) -> DataFrame:
    return x.where(F.col("v") != value)


def clear(x: DataFrame) -> DataFrame:
    return x.limit(0)


def has(x: DataFrame, value) -> bool:
    return not x.where(F.col("v") == value).isEmpty()


def summary(x: DataFrame, at: int | None = None) -> DataFrame:
    """One row: len, is_empty, min, max, lower_bound; sentinels stand for what an empty set lacks."""
    aggs = [F.count_distinct("v").alias("len"), (F.count("v") == 0).alias("is_empty"), F.coalesce(F.min("v"), F.lit(MOST)).alias("min"), F.coalesce(F.max("v"), F.lit(LEAST)).alias("max")]
    if at is not None:
        aggs.append(F.coalesce(F.min(F.when(F.col("v") >= at, F.col("v"))), F.lit(MOST)).alias("lower_bound"))
    return x.agg(*aggs)


def take_min(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(least, rest)."""
    least = x.agg(F.min("v").alias("v"))
    return least, x.join(F.broadcast(least), "v", "left_anti")


def relation(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: intersects, subset, superset, equal."""
    tagged = x.distinct().withColumn("__s", F.lit(1)).unionByName(y.distinct().withColumn("__s", F.lit(2)))
    side = tagged.groupBy("v").agg(F.sum("__s").alias("s"))
    any_ = lambda k: F.coalesce(F.bool_or(F.col("s") == k), F.lit(False))
    return side.agg(any_(3).alias("intersects"), (~any_(1)).alias("subset"), (~any_(2)).alias("superset"), (~any_(1) & ~any_(2)).alias("equal"))


def text(x: DataFrame) -> DataFrame:
    """``{1 2 3}``."""
    return x.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda v: v.cast("string")), " "), F.lit("}")).alias("text"))


def bit_text(values: list[int]) -> str:
    """Binary text of a small set, highest bit first; a point stands before negative members."""
    if not values:
        return "0"
    held, low, high = set(values), min(*values, 0), max(*values, 0)
    whole = "".join("1" if i in held else "0" for i in range(high, -1, -1))
    part = "".join("1" if i in held else "0" for i in range(-1, low - 1, -1))
    return whole + ("." + part if part else "")


# maps


def map_merge(left: Column, right: Column) -> Column:
    """Union of keys; the left value wins."""
    return F.map_concat(F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k)), left)


def map_merge_with(left: Column, right: Column, collide) -> Column:
    """Union of keys; ``collide`` joins the values of a key on both sides."""
    return F.map_zip_with(left, right, lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(collide(a, b)))


def map_intersect(left: Column, right: Column) -> Column:
    return F.map_filter(left, lambda k, _: F.map_contains_key(right, k))


def map_intersect_with(left: Column, right: Column, collide) -> Column:
    both = F.map_zip_with(map_intersect(left, right), map_intersect(right, left), lambda _, a, b: collide(a, b))
    return both


def map_insert(m: Column, key: Column, value: Column) -> Column:
    """Insert unless the key is there."""
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(key, value)))


def map_update(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(map_remove(m, key), F.create_map(key, value))


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def same_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


def map_sorted(m: Column) -> Column:
    """Entries by key."""
    return F.array_sort(F.map_entries(m))


def uniquify(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


# runs


def runs(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Maximal runs of consecutive values per group: first, last, n; repeated values count once."""
    w = Window.partitionBy(*group).orderBy(value)
    once = rows.select(*group, value).distinct()
    island = once.withColumn("__k", F.col(value) - F.row_number().over(w))
    return island.groupBy(*group, "__k").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("__k")


def upsert(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``updates`` replace those of equal keys."""
    return rows.join(updates.select(keys).distinct(), keys, "left_anti").unionByName(updates)
