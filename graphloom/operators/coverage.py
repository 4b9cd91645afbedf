"""Coverage blocks ``(file, mode, start_line, start_col, end_line, end_col, num_stmt, count)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = ["start_line", "start_col", "end_line", "end_col"]


def merge(blocks: DataFrame) -> DataFrame:
    """Equal blocks become one: counts are OR-ed in mode ``set``, else added; a block with two statement counts fails."""
    grouped = blocks.groupBy("file", "mode", *POSITION).agg(
        F.min("num_stmt").alias("num_stmt"), F.max("num_stmt").alias("__most"), F.bit_or("count").alias("__or"), F.sum("count").alias("__sum")
    )
    checked = F.when(F.col("num_stmt") != F.col("__most"), F.raise_error(F.lit("inconsistent NumStmt"))).otherwise(F.when(F.col("mode") == "set", F.col("__or")).otherwise(F.col("__sum")))
    return grouped.select("file", "mode", *POSITION, "num_stmt", checked.cast("long").alias("count"))


def ordered(blocks: DataFrame) -> DataFrame:
    return blocks.orderBy("file", "start_line", "start_col")


def boundaries(blocks: DataFrame, line_offsets: DataFrame) -> DataFrame:
    """(file, offset, is_start, count, norm, index): where blocks open and close, by ``line_offsets (file, line, offset)``.

    norm = ln(count) / ln(max count of the file); 0.8 for a positive count when the max is at most 1, else 0.
    """
    most = blocks.groupBy("file").agg(F.max("count").alias("most"))
    c, m = F.col("count").cast("double"), F.col("most").cast("double")
    norm = F.when(F.col("count") <= 0, F.lit(0.0)).when(m <= 1, F.lit(0.8)).otherwise(F.log(c) / F.log(m))
    whole = blocks.join(most, "file").withColumn("norm", norm)
    ends = F.explode(
        F.array(
            F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.lit(True).alias("is_start")),
            F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col"), F.lit(False).alias("is_start")),
        )
    )
    each = whole.select("file", "count", "norm", ends.alias("e")).select("file", "count", "norm", "e.*")
    placed = each.join(line_offsets.withColumnRenamed("offset", "__at"), ["file", "line"])
    return placed.select("file", (F.col("__at") + F.col("col") - 1).alias("offset"), "is_start", "count", F.when(F.col("is_start"), F.col("norm")).otherwise(0.0).alias("norm"))


def percent_covered(blocks: DataFrame) -> DataFrame:
    """(file, covered, total, percent) statements."""
    hit = F.when(F.col("count") > 0, F.col("num_stmt")).otherwise(0)
    out = blocks.groupBy("file").agg(F.sum(hit).alias("covered"), F.sum("num_stmt").alias("total"))
    return out.withColumn("percent", 100.0 * F.col("covered") / F.col("total"))
