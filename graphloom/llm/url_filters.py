"""URL filtering with pattern rules indexed by their rarest literal token.

A pattern runs only on urls that hold the rarest token it needs, so each url
meets few of many rules.  Rarity is counted over all urls.  List rules (host
and path prefix) are tested as column expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named

#: (rule, verdict): host with subdomains, then path prefix; the longest that fits wins.
LIST_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Patterns, searched in the lower-cased url.
PATTERN_RULES = (
    r"[?&]utm_source=",
    r"[?&]ref=",
    r"[?&](sessionid|sid)=",
    r"[./-](casino|poker)[./-]",
    r"[./-](porn|xxx)[./-]",
    r"/(ads|banner|doubleclick)/",
    r"\.(exe|zip|torrent)$",
    r"://m\.",
)
_ATOM = re.compile(r"(?P<run>[a-z0-9]+)|(?P<sep>\\[^a-z0-9]|[\^$/=:_%&~@,;-]|\[[^\]\\^a-z0-9]+\])|(?P<other>.)")
_TOKEN = re.compile(r"[a-z0-9]+")


def rule_tokens(pattern: str) -> list[list[str]]:
    """For each branch of the pattern's (a|b|c) group, the whole url tokens any match must hold.

    A run of letters and digits counts only between separators, since else it
    could be part of a longer token.
    """
    group = re.search(r"(?<!\\)\(([a-z0-9|]+)\)(?![?*+{])", pattern)
    branches = [pattern[: group.start()] + x + pattern[group.end() :] for x in group[1].split("|")] if group else [pattern]
    out = []
    for branch in branches:
        atoms = [(m.lastgroup, m[0]) for m in _ATOM.finditer(branch)]
        atoms = [("other", x) if i + 1 < len(atoms) and atoms[i + 1][1] in "?*+{" else (kind, x) for i, (kind, x) in enumerate(atoms)]
        out.append([x for i, (kind, x) in enumerate(atoms) if kind == "run" and 0 < i < len(atoms) - 1 and atoms[i - 1][0] == atoms[i + 1][0] == "sep"])
    return out


def rule_index(urls: DataFrame, patterns=PATTERN_RULES) -> dict[str, list[str]]:
    """token -> patterns; every branch is listed under that token of it which the fewest urls hold.

    A branch without a whole token goes under "", whose rules run on every url.
    """
    tokens = {p: rule_tokens(p) for p in patterns}
    wanted = sorted({t for ts in tokens.values() for branch in ts for t in branch})
    held = F.array_intersect(F.split(F.lower("url"), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in wanted])) if wanted else F.array().cast("array<string>")
    counts = {r["token"]: r["count"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()}  # at most a row for each literal
    index: dict[str, list[str]] = defaultdict(list)
    for p, branches in tokens.items():
        for key in {min(b, key=lambda t: (counts.get(t, 0), t)) if b else "" for b in branches}:
            index[key].append(p)
    return dict(index)


def pattern_hits(index: dict[str, list[str]]):
    """Column function: how many of the indexed patterns a url matches."""

    @F.pandas_udf("int")
    def hits(urls: pd.Series) -> pd.Series:
        compiled = {t: [re.compile(p) for p in ps] for t, ps in index.items()}
        always = compiled.get("", [])

        def one(url: str | None) -> int:
            if url is None:
                return 0
            low = url.lower()
            rules = {r for t in set(_TOKEN.findall(low)) if t in compiled for r in compiled[t]}
            return sum(r.search(low) is not None for r in rules.union(always))

        return urls.map(one).astype("int32")

    return hits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", list_rules=LIST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_patterns.

    Null or malformed urls have an empty host and path and fit no list rule; a
    null url matches no pattern and is allowed.  Repeated rows are judged each,
    urls of any length whole; an empty table gives no row, and further columns
    are passed over.
    Nothing is shuffled but one count per literal token.
    """
    base = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"))
    hits = pattern_hits(rule_index(base, patterns))
    host, path = host_and_path(F.col("url"))
    urls = base.withColumns({"host": host, "path": path, "n_patterns": hits("url")})
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(list_rules, key=lambda r: (len(r[0]), r)):  # a longer rule overrides
        cut = rule.index("/")
        fits = ((F.col("host") == rule[:cut]) | F.endswith("host", F.lit("." + rule[:cut]))) & F.startswith("path", F.lit(rule[cut:]))
        best, verdict = F.when(fits, F.lit(rule)).otherwise(best), F.when(fits, F.lit(what)).otherwise(verdict)
    final = F.coalesce(verdict, F.when(F.col("n_patterns") > 0, "block").otherwise("allow"))
    return urls.select("page_id", "host", "path", best.alias("rule"), final.alias("verdict"), "n_patterns")
