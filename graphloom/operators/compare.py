"""Comparing two sets of benchmark rows ``(name, ord, n, ns_per_op, alloced_bytes_per_op, allocs_per_op, mb_per_s, measured)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS, MB, BYTES, ALLOCS = 1, 2, 4, 8
METRICS = {"ns_per_op": NS, "mb_per_s": MB, "alloced_bytes_per_op": BYTES, "allocs_per_op": ALLOCS}


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy("name").orderBy("ord")))


def correlate(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs of rows of one name, by position; names whose counts differ are left out.

    Columns come back as structs ``before`` and ``after``.
    """
    counts = name_counts(before, after).where("n_before = n_after").select("name")
    b = ranked(before).select("name", "__rn", F.struct(*[F.col(c) for c in before.columns]).alias("before"))
    a = ranked(after).select("name", "__rn", F.struct(*[F.col(c) for c in after.columns]).alias("after"))
    return b.join(a, ["name", "__rn"]).join(counts, "name", "left_semi").select("name", "before", "after")


def name_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, n_before, n_after), a zero where a side lacks the name."""
    sides = before.select("name", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("name", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return sides.groupBy("name").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))


def unmatched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names left out with a warning: held before, and not as often after.  Names new in ``after`` go unnoticed."""
    return name_counts(before, after).where("n_before > 0 AND n_after > 0 AND n_before != n_after")


def ratio(before: Column, after: Column) -> Column:
    """after / before; 1 when both are zero, infinite when only ``before`` is."""
    return F.when(before != 0, after / before).when(after == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))


def magnitude(before: Column, after: Column) -> Column:
    """Smaller over larger: 1 for no change, near 0 for a big one, infinite when just one is zero."""
    low, high = F.least(before, after), F.greatest(before, after)
    return F.when((before == 0) & (after == 0), F.lit(1.0)).when((before == 0) | (after == 0), F.lit(float("inf"))).otherwise(low / high)


def percent_text(r: Column) -> Column:
    return F.when(r == float("inf"), F.lit("+Inf%")).otherwise(F.format_string("%+.2f%%", r * 100 - 100))


def multiple_text(r: Column) -> Column:
    return F.when(r == float("inf"), F.lit("+Infx")).otherwise(F.format_string("%.2fx", r))


def changed(before: Column, after: Column) -> Column:
    return before != after


def measured_in_both(pairs: DataFrame, flag: int) -> Column:
    return (F.col("before.measured").bitwiseAND(flag) != 0) & (F.col("after.measured").bitwiseAND(flag) != 0)


def deltas(pairs: DataFrame, metric: str, only_changed: bool = False) -> DataFrame:
    """(name, before, after, ratio, mag) of one metric, for pairs that measured it on both sides."""
    b, a = F.col(f"before.{metric}").cast("double"), F.col(f"after.{metric}").cast("double")
    out = pairs.where(measured_in_both(pairs, METRICS[metric]))
    out = out.where(changed(b, a)) if only_changed else out
    return out.select("name", F.col("before.ord").alias("ord"), b.alias("before"), a.alias("after"), ratio(b, a).alias("ratio"), magnitude(b, a).alias("mag"))


def by_delta(found: DataFrame) -> DataFrame:
    """Biggest change first, then name, then parse order, so that no tie is open; a change from or to zero comes last."""
    return found.orderBy(F.col("mag").asc(), "name", "ord")


def by_parse_order(found: DataFrame) -> DataFrame:
    return found.orderBy("ord", "name")


def best(rows: DataFrame) -> DataFrame:
    """Per name the row of least ns_per_op, the first on ties.

    It takes the place of the group's first row unless that is itself the best.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    pick = rows.groupBy("name").agg(F.min_by(whole, F.struct("ns_per_op", "ord")).alias("row"), F.min("ord").alias("first"))
    return pick.select(*[(F.col("first") if c == "ord" else F.col(f"row.{c}")).alias(c) for c in rows.columns])


def format_ns(ns: Column) -> Column:
    """Two decimals under 10, one under 100, else none."""
    return F.when(ns < 10, F.format_string("%.2f", ns)).when(ns < 100, F.format_string("%.1f", ns)).otherwise(F.format_string("%.0f", ns))


def benchmark_text() -> Column:
    """Canonical line of a row: name, iterations, and the measured figures."""
    on = lambda bit, fmt, c: F.when(F.col("measured").bitwiseAND(bit) != 0, F.format_string(fmt, c))
    return F.concat_ws(
        " ", "name", F.col("n").cast("string"), on(NS, "%.2f ns/op", F.col("ns_per_op")), on(MB, "%.2f MB/s", F.col("mb_per_s")),
        on(BYTES, "%d B/op", F.col("alloced_bytes_per_op")), on(ALLOCS, "%d allocs/op", F.col("allocs_per_op")),
    )


def scaled_units(v: Column, suffixes: list[str]) -> Column:
    """The value over the largest power of 1000 that the suffixes reach, with two decimals."""
    out = F.format_string("%.2f" + suffixes[-1], v / 1000.0 ** (len(suffixes) - 1))
    for k in reversed(range(len(suffixes) - 1)):
        out = F.when(v < 1000.0 ** (k + 1), F.format_string("%.2f" + suffixes[k], v / 1000.0**k)).otherwise(out)
    return out
