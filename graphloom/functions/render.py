"""Output formats as columns and line frames: graph drawings, metric exposition, telemetry JSON, feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot_escape(s: Column) -> Column:
    """Quotes, backslashes, braces, angle brackets, bars escaped in one pass; newlines as ``\\n``."""
    return F.replace(F.regexp_replace(s, r'([\\"{}<>|])', r"\\$1"), F.lit("\n"), F.lit("\\n"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, a, b, line): statement lines of a drawing, nodes before edges; the frame is sorted by those columns when written."""
    n = nodes.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("a"), F.lit("").alias("b"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b")).distinct()
    q = lambda c: F.concat(F.lit('"'), dot_escape(F.col(c)), F.lit('"'))
    line = F.when(F.col("part") == 1, F.concat(F.lit("  "), q("a"), F.lit(";"))).otherwise(F.concat(F.lit("  "), q("a"), F.lit(" -> "), q("b"), F.lit(";")))
    return n.unionByName(e).withColumn("line", line)


def exposition(metrics: DataFrame, name: str, labels: list[str], bounds: list[float]) -> DataFrame:
    """(series, line) of cumulative histograms: a line per bucket, ``+Inf``, count and sum."""
    tag = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    at = F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf"))
    counts = F.concat(F.col("values"), F.array(F.col("count").cast("long")))
    buckets = F.transform(F.arrays_zip(at.alias("le"), counts.alias("n")), lambda x: F.concat(F.lit(f"{name}_bucket{{"), tag, F.lit(',le="'), x["le"], F.lit('"} '), x["n"].cast("string")))
    tail = F.array(F.concat(F.lit(f"{name}_count{{"), tag, F.lit("} "), F.col("count").cast("string")), F.concat(F.lit(f"{name}_sum{{"), tag, F.lit("} "), F.col("sum").cast("string")))
    return metrics.select(tag.alias("series"), F.explode(F.concat(buckets, tail)).alias("line"))


def metric_json(metrics: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """One JSON object per group."""
    point = F.struct(F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[F.col(x).cast("string") for x in labels])).alias("labels"), *[F.col(c) for c in metrics.columns if c not in labels])
    return metrics.select(F.to_json(F.struct(F.lit(name).alias("name"), point.alias("point"))).alias("json"))


def span_json(spans: DataFrame) -> DataFrame:
    return spans.select(F.to_json(F.struct("owner", "span", "name", "start", "finish")).alias("json"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def feed(items: DataFrame, time: str, limit: int) -> DataFrame:
    """The newest items: a feed is bounded by its configuration."""
    return items.orderBy(F.desc(time)).limit(limit)


def unified_diff(before: Column, after: Column, context: int = 3) -> Column:
    """Unified diff text of two texts."""
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import unified_diff as diff

        one = lambda x, y: "".join(diff((x or "").splitlines(True), (y or "").splitlines(True), "old", "new", n=context))
        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return run(before, after)


EDITS = "array<struct<start:int,end:int,new:string>>"


def _differ():
    """A function of two texts, made here so that it is pickled by value."""

    def one(x: str | None, y: str | None) -> list[dict]:
        from difflib import SequenceMatcher

        p, q = (x or "").splitlines(True), (y or "").splitlines(True)
        at = [0]
        for line in p:
            at.append(at[-1] + len(line.encode()))
        ops = SequenceMatcher(None, p, q, autojunk=False).get_opcodes()
        return [{"start": at[i1], "end": at[i2], "new": "".join(q[j1:j2])} for tag, i1, i2, j1, j2 in ops if tag != "equal"]

    return one


def _applier():
    def one(x: str | None, changes) -> str:
        raw, out, at = (x or "").encode(), [], 0
        for c in sorted(changes if changes is not None else [], key=lambda c: (c["start"], c["end"])):
            if c["start"] < at or c["end"] > len(raw):
                raise ValueError("edits overlap or lie outside the text")
            out += [raw[at : c["start"]], c["new"].encode()]
            at = c["end"]
        return b"".join([*out, raw[at:]]).decode()

    return one


def line_edits(before: Column, after: Column) -> Column:
    """Line-wise edits: half-open byte ranges of the old text and what replaces them."""
    one = _differ()

    @F.pandas_udf(EDITS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return run(before, after)


def apply_edits(text: Column, edits: Column) -> Column:
    """The text with sorted, non-overlapping edits applied; others are an error."""
    one = _applier()

    @F.pandas_udf("string")
    def run(t: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([one(x, c) for x, c in zip(t, e)])

    return run(text, edits)


def round_trip(before: Column, after: Column) -> Column:
    """(n, ok): how many line edits there are, and whether applying them gives the text; a worker holds one row's edits at a time."""
    differ, applier = _differ(), _applier()

    @F.pandas_udf("n int, ok boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        ns, oks = [], []
        for x, y in zip(a, b):
            edits = differ(x, y)
            ns.append(len(edits))
            oks.append(None if y is None else applier(x, edits) == y)
        return pd.DataFrame({"n": ns, "ok": pd.Series(oks, dtype=object)})

    return run(before, after)
