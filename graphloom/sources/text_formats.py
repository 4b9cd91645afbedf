"""Readers of line- and block-oriented tool formats, as DataFrames over ``spark.read.text``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# adjacency lists

_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"')
_ESCAPE = re.compile(r"\\(?:([0-7]{3})|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([abfnrtv\\\"']))")
_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}


def unquote(literal: str) -> str:
    """The value of a double-quoted literal; a bad one is an error."""
    body = literal[1:-1]
    if _ESCAPE.sub("", body).count("\\"):
        raise ValueError(f"bad escape in {literal}")
    return _ESCAPE.sub(lambda m: _SIMPLE[m[5]] if m[5] else chr(int(m[1], 8) if m[1] else int(m[2] or m[3] or m[4], 16)), body)


def split_words(line: str) -> list[str]:
    """White-space separated words; quoted literals may be glued into a word."""
    out: list[str] = []
    i, open_ = 0, False
    while i < len(line):
        if line[i].isspace():
            open_, i = False, i + 1
            continue
        if not open_:
            out.append("")
            open_ = True
        if line[i] == '"':
            m = _QUOTED.match(line, i)
            if not m:
                raise ValueError(f"unterminated quote in line {line!r}")
            out[-1] += unquote(m[0])
            i = m.end()
        else:
            out[-1] += line[i]
            i += 1
    return out


def words_of_line(line: Column) -> Column:
    """Words of a line: plain lines stay in generated code, lines with a quote go to Python."""
    quoted = F.pandas_udf(lambda s: s.map(lambda x: split_words(x) if x is not None and '"' in x else None), "array<string>")
    plain = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.contains(line, F.lit('"')), quoted(line)).otherwise(plain)


def digraph(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of adjacency lines: the first word leads to every later one; a lone word is a node."""
    w = lines.select(words_of_line(F.col(column)).alias("w")).where("size(w) > 0")
    nodes = w.select(F.explode("w").alias("id")).distinct()
    edges = w.select(F.element_at("w", 1).alias("src"), F.explode(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))).alias("dst")).distinct()
    return nodes, edges


def read_digraph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return digraph(spark.read.text(path))


# benchmark output


def benchmark_rows(lines: DataFrame, column: str = "value", order: str = "line", group: list[str] | None = None) -> DataFrame:
    """Rows of benchmark lines; other lines are skipped, ``ord`` numbers those accepted within a group (a file).

    Figures come in (value, unit) pairs; an unknown unit or a value that is no
    number leaves its bit of ``measured`` unset.
    """
    w = lines.withColumn("__f", F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != ""))
    ok = w.where(F.startswith(F.get("__f", F.lit(0)), F.lit("Benchmark")) & F.get("__f", F.lit(1)).rlike(r"^[+-]?[0-9]{1,18}$"))
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.size("__f") - 2, F.lit(2)), F.lit(2)), lambda i: F.struct(F.get("__f", i).alias("v"), F.get("__f", i + 1).alias("u")))
    value = lambda unit, kind: F.try_element_at(F.transform(F.filter("__p", lambda p: (p["u"] == unit) & p["v"].try_cast(kind).isNotNull()), lambda p: p["v"].try_cast(kind)), F.lit(-1))
    bit = lambda c, b: F.when(F.col(c).isNotNull(), b).otherwise(0)
    rows = (
        ok.withColumn("__p", pairs)
        .withColumns({"ns_per_op": value("ns/op", "double"), "mb_per_s": value("MB/s", "double"), "alloced_bytes_per_op": value("B/op", "long"), "allocs_per_op": value("allocs/op", "long")})
        .withColumn("measured", bit("ns_per_op", 1) + bit("mb_per_s", 2) + bit("alloced_bytes_per_op", 4) + bit("allocs_per_op", 8))
    )
    ord_ = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(order)) - 1
    return rows.select(*(group or []), F.get("__f", F.lit(0)).alias("name"), F.get("__f", F.lit(1)).cast("long").alias("n"), "ns_per_op", "mb_per_s", "alloced_bytes_per_op", "allocs_per_op", "measured", ord_.alias("ord"))


# coverage profiles

COVER_LINE = r"^(.+):([0-9]+)\.([0-9]+),([0-9]+)\.([0-9]+) ([0-9]+) ([0-9]+)$"


def cover_rows(lines: DataFrame, column: str = "value", profile: str = "profile") -> DataFrame:
    """Blocks of coverage lines; ``mode:`` lines give a profile's mode, any other line that doesn't parse is an error."""
    mode = F.regexp_extract(column, r"^mode: (\S+)$", 1)
    w = Window.partitionBy(profile)
    held = lines.withColumn("mode", F.max(F.nullif(mode, F.lit(""))).over(w)).where((mode == "") & (F.col(column) != ""))
    part = lambda i: F.regexp_extract(column, COVER_LINE, i)
    checked = F.when(F.col(column).rlike(COVER_LINE) & F.col("mode").isNotNull(), part(1)).otherwise(F.raise_error(F.concat(F.lit("bad coverage line: "), F.col(column))).cast("string"))
    names = ("start_line", "start_col", "end_line", "end_col", "num_stmt")
    return held.select(profile, checked.alias("file"), "mode", *[part(i + 2).cast("int").alias(n) for i, n in enumerate(names)], part(7).cast("long").alias("count"))


# text archives

_MARK = re.compile(r"^-- (.*?) --\s*$", re.M)


def split_archive(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Comment and ordered (name, data) files; a last line without newline gets one."""
    marks = [m for m in _MARK.finditer(text) if m[1].strip()]
    ended = lambda s: s if not s or s.endswith("\n") else s + "\n"
    comment = ended(text[: marks[0].start()] if marks else text)
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return comment, [(m[1].strip(), ended(text[m.end() :][: e - m.end()].removeprefix("\n"))) for m, e in zip(marks, ends)]


def archive_files(archives: DataFrame, name: str, text: str) -> DataFrame:
    """(archive, ord, name, data); the comment is row -1 with an empty name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, body in zip(b["archive"], b["text"]):
                comment, files = split_archive(body or "")
                rows.append((archive, -1, "", comment))
                rows += [(archive, i, n, d) for i, (n, d) in enumerate(files)]
            yield pd.DataFrame(rows, columns=["archive", "ord", "name", "data"])

    return archives.select(F.col(name).cast("string").alias("archive"), F.col(text).alias("text")).mapInPandas(run, "archive string, ord int, name string, data string")


def format_archive(files: DataFrame) -> DataFrame:
    """(archive, text): the files of each archive after its comment, in order."""
    part = F.when(F.col("ord") < 0, F.col("data")).otherwise(F.concat(F.lit("-- "), "name", F.lit(" --\n"), "data"))
    return files.groupBy("archive").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda s: s["p"]), "").alias("text"))


def duplicate_names(files: DataFrame) -> DataFrame:
    return files.where("ord >= 0").groupBy("archive", "name").count().where("count > 1")


# module index

SYMBOL_KINDS = {"C": "const", "F": "func", "T": "type", "V": "var"}


def index_entries(lines: DataFrame, column: str = "value", order: str = "line", file: str = "file") -> DataFrame:
    """(pkg_name, import_path, dir, version, symbol, kind): header lines begin ``:`` with comma-separated fields, symbols follow."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.startswith(column, F.lit(":")), F.col(column))
    held = lines.withColumn("__h", F.last(header, ignorenulls=True).over(w)).where("__h IS NOT NULL")
    part = lambda i: F.get(F.split(F.substring("__h", F.lit(2), F.length("__h")), ","), F.lit(i))
    symbols = held.where(header.isNull())
    fields = F.split(column, " ")
    return symbols.select(
        file, part(0).alias("pkg_name"), part(1).alias("import_path"), part(2).alias("dir"), part(3).alias("version"),
        F.get(fields, F.lit(0)).alias("symbol"), F.substring(F.get(fields, F.lit(1)), 1, 1).alias("kind"), F.contains(F.get(fields, F.lit(1)), F.lit("D")).alias("deprecated"),
        F.transform(F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 2, F.lit(0))), lambda x: F.translate(x, "$", " ")).alias("signature"),
    )


# messages and notes

MESSAGE = "jsonrpc string, id string, method string, params string, result string, error struct<code:long,message:string>"


def wire_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Wire messages by kind: call, notification or response."""
    m = F.from_json(column, MESSAGE)
    kind = F.when(F.col("m.method").isNotNull(), F.when(F.col("m.id").isNotNull(), "call").otherwise("notification")).when(F.col("m.id").isNotNull(), "response").otherwise("invalid")
    return lines.withColumn("m", m).select(kind.alias("kind"), "m.id", "m.method", "m.params", "m.result", "m.error")


def tagged_messages(lines: DataFrame, kinds: list[str], column: str = "value") -> DataFrame:
    """(kind, body): JSON objects with one member each, dispatched by which member that is."""
    v = F.from_json(column, ", ".join(f"{k} string" for k in kinds))
    rows = lines.withColumn("__v", v).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"__v.{k}").alias("body")) for k in kinds])).alias("x"))
    return rows.select("x.kind", "x.body").where("body IS NOT NULL")


def notes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Expectation comments ``//@name(args)``, with what else the line's row has."""
    found = F.regexp_extract_all(column, F.lit(r"@([A-Za-z_]\w*)\(([^()]*(?:\([^()]*\)[^()]*)*)\)"), F.lit(0))
    rows = lines.where(F.contains(column, F.lit("//@"))).withColumn("note", F.explode(found))
    return rows.withColumns({"name": F.regexp_extract("note", r"@(\w+)\(", 1), "args": F.regexp_extract("note", r"^@\w+\((.*)\)$", 1)}).drop("note")


# slide markup


def outline(docs: DataFrame, text: str) -> DataFrame:
    """(.., title, sections array<struct<level, title>>) of slide markup: first line title, ``##`` or ``*`` lines sections."""
    lines = F.split(text, "\n")
    heads = F.filter(lines, lambda x: x.rlike(r"^(\*+|##+) "))
    level = lambda x: F.length(F.regexp_extract(x, r"^(\*+|##+) ", 1)) - F.when(F.startswith(x, F.lit("#")), 1).otherwise(0)
    return docs.withColumns({"title": F.regexp_replace(F.get(lines, F.lit(0)), "^# ", ""), "sections": F.transform(heads, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, r"^(\*+|##+) ", "").alias("title")))})
