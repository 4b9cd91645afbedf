"""Event metrics and spans.  The aggregations work on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def scalar(events: DataFrame, keys: list[str], value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """count, sum and latest value per group; a missing key is a null member."""
    return events.groupBy(*keys).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"), F.max_by(value, F.struct(ts, tie)).alias("latest")
    )


def histogram(events: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """count, sum, min, max, and for every bound how many values are at most it (cumulative)."""
    buckets = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).cast("long") for b in bounds]
    return events.groupBy(*keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.array(*buckets).alias("values"))


def first_bucket(value: Column, limits: list[float]) -> Column:
    """Index of the first limit over the value; null beyond the last."""
    out = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(limits))):
        out = F.when(value < b, F.lit(i)).otherwise(out)
    return out


def exclusive_histogram(calls: DataFrame, keys: list[str], latency: str, limits: list[float]) -> DataFrame:
    """Per group: completed, min, max, sum, mean, and counts by first limit over the latency; overflow is in no bucket."""
    bucket = first_bucket(F.col(latency), limits)
    counts = [F.count(F.when(bucket == i, 1)) for i in range(len(limits))]
    return calls.groupBy(*keys).agg(
        F.count(latency).alias("completed"), F.min(latency).alias("min"), F.max(latency).alias("max"), F.sum(latency).alias("sum"),
        (F.sum(latency) / F.count(latency)).alias("mean"), F.array(*counts).alias("values"),
    )


def latency_counter(calls: DataFrame, operation: str, latency: str, is_error: Column, limits: list[float]) -> DataFrame:
    """(operation, bucket, is_error, n): latencies under the last limit by first bucket."""
    placed = calls.withColumns({"bucket": first_bucket(F.col(latency), limits), "is_error": is_error}).where("bucket IS NOT NULL")
    return placed.groupBy(operation, "bucket", "is_error").agg(F.count(F.lit(1)).alias("n"))


def rates(stats: DataFrame, started: str, completed: str, sent: str) -> DataFrame:
    """Adds in_progress and sent_mean."""
    return stats.withColumns({"in_progress": F.col(started) - F.col(completed), "sent_mean": F.try_divide(sent, started)})


def spans(events: DataFrame, owner: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Pairs an owner's start and end marks: consecutive events, taken two by two.

    (owner, span, name, start, finish, elapsed_us); a last event alone stays open, without finish.
    """
    w = Window.partitionBy(owner).orderBy(ts, tie)
    marked = events.withColumns({"__n": F.row_number().over(w), "finish": F.lead(ts).over(w)}).where("__n % 2 = 1")
    elapsed = micros("finish") - micros(ts)
    return marked.select(F.col(owner).alias("owner"), ((F.col("__n") + 1) / 2).cast("long").alias("span"), F.col("event_type").alias("name"), F.col(ts).alias("start"), "finish", elapsed.alias("elapsed_us"))


def span_extremes(found: DataFrame) -> DataFrame:
    """Per name the last span to finish and the longest; the earlier start wins ties."""
    done = found.where("finish IS NOT NULL")
    return done.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("finish").alias("last_finish"),
        F.max("elapsed_us").alias("longest_us"),
        F.max_by("owner", F.struct(F.col("elapsed_us"), -micros("start"), -F.col("owner"))).alias("longest_owner"),
    )


def recent(events: DataFrame, keys: list[str], n: int = 100, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last ``n`` rows of every group: the feature is the bounded log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def offsets(events: DataFrame, group: str, ts: str = "ts") -> DataFrame:
    """Adds offset_us: time since the group's first event."""
    return events.withColumn("offset_us", micros(ts) - F.min(micros(ts)).over(Window.partitionBy(group)))


def carry_labels(events: DataFrame, owner: str, label: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Fills a label forward along each owner's events."""
    w = Window.partitionBy(owner).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(label, F.last(label, ignorenulls=True).over(w))


def node_percent(rows: DataFrame, kind: str) -> DataFrame:
    """Frequency and percent of the total by kind."""
    total = rows.count()
    n = rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("kind", "n", (100.0 * F.col("n") / F.lit(total)).alias("percent"))


def line_counts(files: DataFrame, levels: list[str], lines: Column) -> DataFrame:
    """Totals at every level of a hierarchy at once: a row per prefix of the levels, and one for all."""
    return files.withColumn("__lines", lines).rollup(*levels).agg(F.sum("__lines").alias("lines"), F.grouping_id().alias("level"))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
