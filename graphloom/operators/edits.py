"""Merging, widening and undoing text edits: plain functions on one text's edits, and columns over many."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.render import EDITS

Edit = tuple[int, int, str]


def merge(x: list[Edit], y: list[Edit]) -> list[Edit] | None:
    """Both sides' edits of one text; equal edits count once; None if two overlap, or insert differently at one place."""
    out: list[Edit] = []
    for e in sorted({*x, *y}):
        if out:
            last = out[-1]
            if e[0] < last[1] or (e[:2] == last[:2] and e[0] == e[1]):
                return None
            if e[:2] == last[:2]:
                return None
        out.append(e)
    return out


def widen(text: str, edits: list[Edit]) -> list[Edit]:
    """Edits widened to whole lines; neighbours on one line become one."""
    out: list[Edit] = []
    for start, end, new in sorted(edits):
        first = text.rfind("\n", 0, start) + 1
        last = end if end > start and text[end - 1 : end] == "\n" and new.endswith("\n") or (end == first and new.endswith("\n")) else text.find("\n", end) + 1 or len(text)
        if out and first < out[-1][1]:
            a, b, held = out[-1]
            cut = len(held) - (b - start)
            out[-1] = (a, max(b, last), held[:cut] + new + text[end : max(b, last)])
        else:
            out.append((first, last, text[first:start] + new + text[end:last]))
    return out


def apply_unified(diff: str, before: str) -> str:
    """The text a unified diff turns ``before`` into; a hunk that doesn't fit is an error."""
    lines, out, at = before.splitlines(True), [], 0
    hunk = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")
    body = diff.splitlines(True)
    i = 0
    while i < len(body):
        m = hunk.match(body[i])
        i += 1
        if not m:
            continue
        start = int(m[1]) - (0 if m[2] == "0" else 1)
        out += lines[at:start]
        at = start
        while i < len(body) and body[i][:1] in (" ", "-", "+", "\\"):
            kind, rest = body[i][0], body[i][1:]
            if kind in " -":
                if at >= len(lines) or lines[at].rstrip("\n") != rest.rstrip("\n"):
                    raise ValueError("the diff does not fit the text")
                at += 1
            if kind in " +":
                out.append(rest)
            i += 1
    return "".join(out + lines[at:])


def merged(x: Column, y: Column) -> Column:
    """Column form of ``merge``; null on a conflict."""

    @F.pandas_udf(EDITS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p, q):
            found = merge([(e["start"], e["end"], e["new"]) for e in p], [(e["start"], e["end"], e["new"]) for e in q])
            return None if found is None else [{"start": s, "end": t, "new": n} for s, t, n in found]

        return pd.Series([one(p, q) for p, q in zip(a, b)])

    return run(x, y)
