"""Text-level analyzers over source lines ``(file, line, text)``: each gives ``(file, line, category, message)``.

They need lines only; analyzers that need types or control flow take node and
edge tables instead and are not among these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENERATED = r"^// Code generated .* DO NOT EDIT\.$"
TAG = r"`[^`]*`"


def report(lines: DataFrame, test: Column, category: str, message: Column | str) -> DataFrame:
    m = F.lit(message) if isinstance(message, str) else message
    return lines.where(test).select("file", "line", F.lit(category).alias("category"), m.alias("message"))


def _header(lines: DataFrame) -> DataFrame:
    """Adds whether a line stands before the package clause."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("text").rlike(r"^package\s").cast("int")).over(w), F.lit(0))
    return lines.withColumn("__head", (seen == 0) & ~F.col("text").rlike(r"^package\s"))


def misplaced_build_lines(lines: DataFrame) -> DataFrame:
    rows = _header(lines)
    return report(rows, F.col("text").rlike(r"^\s*//(go:build|\s*\+build)\b") & ~F.col("__head"), "buildtag", "misplaced build constraint")


def old_build_lines(lines: DataFrame) -> DataFrame:
    """``// +build`` lines in files that have the newer form."""
    w = Window.partitionBy("file")
    rows = lines.withColumn("__new", F.max(F.startswith("text", F.lit("//go:build")).cast("int")).over(w))
    return report(rows, F.col("text").rlike(r"^//\s*\+build\b") & (F.col("__new") == 1), "plusbuild", "obsolete build line")


def misplaced_directives(lines: DataFrame) -> DataFrame:
    rows = _header(lines)
    return report(rows, F.col("text").rlike(r"^\s*//go:debug\b") & ~F.col("__head"), "directive", "directive after the package clause")


def import_comments(lines: DataFrame) -> DataFrame:
    return report(lines, F.col("text").rlike(r'^package\s+\w+\s*(//|/\*)\s*import\s+"'), "importcomment", "obsolete import comment")


def time_layouts(lines: DataFrame) -> DataFrame:
    return report(lines, F.col("text").rlike(r'"[^"]*2006-02-01[^"]*"'), "timeformat", "2006-02-01 should be 2006-01-02")


def struct_tags(lines: DataFrame) -> DataFrame:
    tag = F.regexp_extract("text", TAG, 0)
    well = tag.rlike(r'^`\s*(?:[^\s:"`\x00-\x1f]+:"(?:[^"\\]|\\.)*"(?:\s+|(?=`)))*`$')
    return report(lines, F.col("text").rlike(r"^\s*[\w, ]+\s+[\w.*\[\]]+\s+" + TAG + r"\s*(//.*)?$") & ~well, "structtag", F.concat(F.lit("malformed tag "), tag))


def embed_directives(lines: DataFrame) -> DataFrame:
    """``//go:embed`` in files that don't import the package it needs."""
    w = Window.partitionBy("file")
    rows = lines.withColumn("__has", F.max(F.col("text").rlike(r'^\s*(import\s+)?(_\s+|\w+\s+)?"embed"').cast("int")).over(w))
    return report(rows, F.col("text").rlike(r"^\s*//go:embed\s") & (F.col("__has") == 0), "embed", "embed must be imported")


def test_names(lines: DataFrame) -> DataFrame:
    bad = F.regexp_extract("text", r"^func\s+((?:Test|Benchmark|Fuzz)[a-z]\w*)\s*\(\s*\w+\s+\*testing\.", 1)
    return report(lines, F.endswith("file", F.lit("_test.go")) & (bad != ""), "tests", F.concat(bad, F.lit(" has a malformed name: the letter after the prefix must be upper case")))


def host_ports(lines: DataFrame) -> DataFrame:
    return report(lines, F.col("text").rlike(r'Sprintf\("%s:(%d|%s)",.*\).*|net\.Dial\w*\([^)]*Sprintf\("%s:'), "hostport", "address format %s:%d fails for IPv6")


def any_type(lines: DataFrame) -> DataFrame:
    return report(lines, F.col("text").rlike(r"\binterface\s*\{\s*\}") & ~F.col("text").rlike(r"^\s*//"), "any", "interface{} can be replaced by any")


def omit_zero(lines: DataFrame) -> DataFrame:
    return report(lines, F.col("text").rlike(r"^\s*\w+\s+(time\.Time|struct\s*\{\s*\})\s+`[^`]*,omitempty"), "omitzero", "omitempty has no effect on struct fields")


def generated_files(lines: DataFrame) -> DataFrame:
    rows = _header(lines)
    return rows.where(F.col("__head") & F.col("text").rlike(GENERATED)).select("file").distinct()


def arity_of_formats(lines: DataFrame) -> DataFrame:
    """Calls of formatting functions whose verbs and arguments differ in number; indexed verbs, spreads and nested calls are passed over."""
    rx = r'\b(?:\w+\.)?\w*[pP]rintf\("((?:[^"\\]|\\.)*)"((?:,\s*[\w.]+)*)\)'
    fmt, args = F.regexp_extract("text", rx, 1), F.regexp_extract("text", rx, 2)
    verbs = F.size(F.filter(F.regexp_extract_all(fmt, F.lit(r"%[-+# 0]*[0-9.]*[A-Za-z%]"), F.lit(0)), lambda v: v != "%%"))
    given = F.length(args) - F.length(F.replace(args, F.lit(","), F.lit("")))
    ok = F.col("text").rlike(rx) & ~fmt.rlike(r"%[^A-Za-z%]*[\[*]")
    return report(lines, ok & (verbs != given), "printf", F.format_string("format has %d verbs but call has %d args", verbs, given.cast("int")))


CHECKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "buildtag": misplaced_build_lines, "plusbuild": old_build_lines, "directive": misplaced_directives, "importcomment": import_comments, "timeformat": time_layouts, "structtag": struct_tags,
    "embed": embed_directives, "tests": test_names, "hostport": host_ports, "any": any_type, "omitzero": omit_zero, "printf": arity_of_formats,
}


def run(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Diagnostics of the named checks, all by default, each in one scan of the lines; generated files are passed over."""
    out = None
    kept = lines.join(generated_files(lines), "file", "left_anti")
    for name in names or list(CHECKS):
        found = CHECKS[name](kept)
        out = found if out is None else out.unionByName(found)
    return out


def required_order(requires: DataFrame, analyzers: DataFrame) -> DataFrame:
    """(id, level): analyzers by when they can run, those without requirements first; a cycle is an error."""
    from .graph import topological_levels

    return topological_levels(analyzers, requires.select(F.col("needs").alias("src"), F.col("analyzer").alias("dst")))
