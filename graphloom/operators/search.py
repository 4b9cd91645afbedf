"""Ranked symbol search: a query is compiled to a score column, scored rows are ranked, the best 100 stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy

TOP = 100


def smart_case(query: str, name: Column) -> tuple[str, Column]:
    """Case counts only if the query has an upper-case letter."""
    return (query, name) if query != query.lower() else (query.lower(), F.lower(name))


def exact(query: str, name: Column) -> Column:
    q, n = smart_case(query, name)
    return F.when(F.contains(n, F.lit(q)), 1.0).otherwise(0.0)


def prefix(query: str, name: Column) -> Column:
    q, n = smart_case(query, name)
    return F.when(F.startswith(n, F.lit(q)), 1.0).otherwise(0.0)


def suffix(query: str, name: Column) -> Column:
    q, n = smart_case(query, name)
    return F.when(F.endswith(n, F.lit(q)), 1.0).otherwise(0.0)


def last_index(query: str, name: Column) -> Column:
    """Start of the last occurrence, -1 if none."""
    q, n = smart_case(query, name)
    back = F.instr(F.reverse(n), q[::-1])
    return F.when(back > 0, F.length(n) - back - len(q) + 1).otherwise(-1)


def compile_query(query: str, name: Column) -> Column:
    """Product of the scores of all fields: ``^prefix``, ``suffix$``, ``'exact``, else fuzzy."""
    out = F.lit(1.0)
    for field in query.split():
        if field.startswith("^"):
            one = prefix(field[1:], name)
        elif field.startswith("'"):
            one = exact(field[1:], name)
        elif field.endswith("$"):
            one = suffix(field[:-1], name)
        else:
            one = F.when(fuzzy.subsequence(field, name), fuzzy.symbol_score(field, name)).otherwise(0.0)
        out = out * one
    return out


def qualified_score(query: str, package: Column, path: Column, name: Column) -> Column:
    """Unqualified; else with the package at 0.8; else with the whole path at 0.6."""
    own = compile_query(query, name)
    short = compile_query(query, F.concat_ws(".", package, name)) * 0.8
    full = compile_query(query, F.concat_ws(".", path, name)) * 0.6
    return F.when(own > 0, own).when(short > 0, short).otherwise(full)


def down_rank(score: Column, in_workspace: Column, exported: Column, depth: Column) -> Column:
    """Half outside the workspace, half again there if not exported, and a percent less per level, three at most."""
    outside = F.when(in_workspace, 1.0).otherwise(F.when(exported, 0.5).otherwise(0.25))
    return score * outside * (1 - 0.01 * F.least(depth, F.lit(3)))


def ranked(symbols: DataFrame, score: Column, name: str = "name", top: int = TOP) -> DataFrame:
    """The best ``top`` with a positive score, by score, shorter name, name."""
    return symbols.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.length(name), name).limit(top)


def one_file_each(files: DataFrame, file: str, in_workspace: str, width: str) -> DataFrame:
    """A file in several packages counts once: in the workspace first, in the widest package then."""
    w = Window.partitionBy(file).orderBy(F.desc(in_workspace), F.desc(width), *[c for c in files.columns if c not in (file, in_workspace, width)])
    return files.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def penalty(depth: Column, unexported: Column, functions: Column) -> Column:
    return (depth - 0.1 * unexported + 0.1 * functions) / 10


def top_per_group(rows: DataFrame, group: str, score: str, n: int = 3) -> DataFrame:
    """The best ``n`` of each group; equal scores by the other columns, in their order."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *[c for c in rows.columns if c not in (group, score)])
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
