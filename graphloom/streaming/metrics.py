"""Event metrics as Structured Streaming queries; the batch operators run on the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files: str = "*.parquet", ts: str = "ts", max_files: int = 1000) -> DataFrame:
    """A file stream over the files of a folder; the event time becomes a timestamp, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", files).parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def counts(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running count and sum per group (update or complete mode)."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"))


def tumbling(events: DataFrame, keys: list[str], ts: str, width: str, late: str) -> DataFrame:
    """Counts per window and group; windows close once the watermark passes them."""
    w = F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), *keys, "count")


def sliding(events: DataFrame, keys: list[str], ts: str, width: str, slide: str, late: str) -> DataFrame:
    w = F.window(ts, width, slide)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), *keys, "count")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: events closer together than the gap."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "count")


def paired_spans(starts: DataFrame, ends: DataFrame, late: str, longest: str) -> DataFrame:
    """Span starts joined with their ends by span id, within a longest duration, so that state is bounded.

    ``starts (span_id, start, name)``, ``ends (span_id, finish)``.
    """
    s = starts.withWatermark("start", late)
    e = ends.withWatermark("finish", late).withColumnRenamed("span_id", "__id")
    on = F.expr(f"span_id = __id AND finish >= start AND finish <= start + INTERVAL {longest}")
    return s.join(e, on).drop("__id")


def run_once(df: DataFrame, folder: str, mode: str, name: str) -> DataFrame:
    """Drive a stream over all that is available now; the result is read from files beside its checkpoint, in a shared folder.

    Executors write the rows and none reach the driver.  In complete mode a
    batch has the whole result, so the last one counts; else all of them do.
    A batch that is run again takes its own place.
    """
    spark, done = df.sparkSession, []

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/{epoch}")
        done.append(f"{folder}/out/{epoch}")

    q = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*(done[-1:] if mode == "complete" else done))


def upsert_sink(df: DataFrame, folder: str, keys: list[str], latest: str, write) -> object:
    """The row of largest ``latest`` per key of every micro-batch to ``write(rows, epoch)``: an upsert sink."""

    def newest(rows: DataFrame, epoch: int) -> None:
        whole = F.struct(*rows.columns)
        write(rows.groupBy(*keys).agg(F.max_by(whole, F.struct(latest, whole)).alias("__row")).select("__row.*"), epoch)

    return df.writeStream.outputMode("update").option("checkpointLocation", folder).foreachBatch(newest).start()
