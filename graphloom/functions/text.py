"""Scalar text functions as columns, and the few that need Python as vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# paths and names


def cut_last(s: Column, sep: str) -> Column:
    """struct(before, after, ok) around the last separator."""
    has = F.contains(s, F.lit(sep))
    after = F.substring_index(s, sep, -1)
    before = F.substring(s, F.lit(1), F.length(s) - F.length(after) - len(sep))
    return F.struct(F.when(has, before).otherwise(s).alias("before"), F.when(has, after).otherwise("").alias("after"), has.alias("ok"))


def within(path: Column, folder: Column) -> Column:
    """Whether a path is the folder or lies beneath it."""
    return (path == folder) | F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


def path_distance(base: Column, target: Column) -> Column:
    """Steps from one folder to another: up to the common ancestor and down."""
    a, b = F.split(base, "/"), F.split(target, "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size(a), F.size(b)).cast("long"))
    return F.when(base == target, F.lit(0).cast("long")).otherwise(F.size(a) + F.size(b) - 2 * common)


def split_field(s: Column) -> Column:
    """``T.f`` -> struct(type, name)."""
    return F.struct(F.split_part(s, F.lit("."), F.lit(1)).alias("type"), F.split_part(s, F.lit("."), F.lit(2)).alias("name"))


def split_method(s: Column) -> Column:
    """``(*T).m`` -> struct(ptr, recv, name)."""
    return F.struct(F.startswith(s, F.lit("(*")).alias("ptr"), F.regexp_extract(s, r"^\(\*?([^)]*)\)", 1).alias("recv"), F.regexp_extract(s, r"\)\.(.*)$", 1).alias("name"))


def dir_version(s: Column) -> Column:
    """``path@version/rest`` -> struct(path, version), the rest joined to the path."""
    m = r"^([^@]*)@([^/]*)(/.*)?$"
    return F.struct(F.concat(F.regexp_extract(s, m, 1), F.regexp_extract(s, m, 3)).alias("path"), F.regexp_extract(s, m, 2).alias("version"))


def fast_split(s: Column) -> Column:
    """First fields by single spaces, the fourth keeps the rest."""
    return F.split(s, " ", 4)


def may_import(importer: Column, imported: Column) -> Column:
    """An ``internal`` folder is open only to what lies beneath its parent."""
    parent = F.regexp_extract(imported, r"^(.*?)/?(?:^|/)internal(?:/|$)(?!.*(?:^|/)internal(?:/|$))", 1)
    closed = imported.rlike(r"(?:^|/)internal(?:/|$)")
    return ~closed | (parent == "") | within(importer, parent)


def path_filter(path: Column, rules: list[str]) -> Column:
    """Ordered ``+dir`` and ``-dir`` rules with ``**`` segments: the last that fits decides, default is to include."""
    out = F.lit(True)
    for rule in rules:
        keep, body = rule[0] == "+", rule[1:]
        rx = "^" + "".join(".*" if part == "**" else re.escape(part) + "/" for part in body.split("/") if part).replace(".*", "(?:.*/)?")
        out = F.when(F.concat(path, F.lit("/")).rlike(rx) if body else F.lit(True), F.lit(keep)).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` within a segment, ``**`` across, ``{a,b}`` groups, ``[!a-z]`` ranges."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]", end + 1
            continue
        if c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            out += ")"
            i += 1
            continue
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:"}.get(c, "|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


# versions

VERSION = r"^(?:go)?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:(rc|beta|alpha)([0-9]+))?$"


def version_key(v: Column) -> Column:
    """Sortable struct of a toolchain version: prereleases sort before their release, invalid versions first."""
    part = lambda i, d: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, VERSION, i), F.lit("")), F.lit("999999999")).cast("int"), F.lit(d))
    kind = F.regexp_extract(v, VERSION, 4)
    stage = F.when(kind == "alpha", 0).when(kind == "beta", 1).when(kind == "rc", 2).otherwise(3)
    return F.struct(v.rlike(VERSION).alias("valid"), part(1, 0).alias("major"), part(2, 0).alias("minor"), part(3, 0).alias("patch"), stage.alias("stage"), part(5, 0).alias("pre"))


SEMVER = r"^v(0|[1-9][0-9]*)(?:\.(0|[1-9][0-9]*))?(?:\.(0|[1-9][0-9]*))?(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"


def semver_valid(v: Column) -> Column:
    return v.rlike(SEMVER)


def semver_key(v: Column) -> Column:
    """Sortable struct; a prerelease sorts before its release."""
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, SEMVER, i), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    pre = F.regexp_extract(v, SEMVER, 4)
    ids = F.transform(F.split(F.substring(pre, F.lit(2), F.length(pre)), r"\."), lambda x: F.struct(F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("k"), F.when(x.rlike("^[0-9]+$"), F.lpad(x, 20, "0")).otherwise(x).alias("x")))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"), ids.alias("ids"))


def semver_canonical(v: Column) -> Column:
    """A leading ``v`` put before a bare or otherwise prefixed version."""
    return F.concat(F.lit("v"), F.regexp_replace(v, r"^(?:v|go)", ""))


def version_language(v: Column) -> Column:
    """``1.21.3`` -> ``1.21``, prefix kept."""
    return F.regexp_extract(v, r"^((?:go)?[0-9]+(?:\.[0-9]+)?)", 1)


# bisecting by 64-bit ids


def bisect_conditions(pattern: str) -> tuple[bool, list[tuple[int, int, bool]]]:
    """(default, [(mask, bits, result)]) of a pattern like ``!01+0-x1f``; ``y`` is all, ``n`` none."""
    text = pattern.lstrip("v")
    enable = not text.startswith("!")
    text = text.lstrip("!")
    if text in ("y", "n"):
        return (text == "y") == enable, []
    out, result = [], True
    for sign, body in re.findall(r"([+-]?)([0-9a-zA-Z]+)", text):
        result = sign != "-"
        width = 4 if body.startswith("x") else 1
        digits = body[1:] if width == 4 else body
        bits = len(digits) * width
        out.append(((1 << bits) - 1, int(digits or "0", 16 if width == 4 else 2), result == enable))
    return not enable, out


def bisect_enabled(ids: Column, pattern: str) -> Column:
    """Whether each id is enabled: the last condition whose suffix fits decides."""
    default, conditions = bisect_conditions(pattern)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    out = F.lit(default)
    for mask, bits, result in conditions:
        out = F.when(ids.bitwiseAND(F.lit(signed(mask)).cast("long")) == F.lit(signed(bits)).cast("long"), F.lit(result)).otherwise(out)
    return out


def bisect_marker(ids: Column) -> Column:
    return F.concat(F.lit("[bisect-match 0x"), F.lpad(F.lower(F.hex(ids)), 16, "0"), F.lit("]"))


def bisect_cut(line: Column) -> Column:
    """struct(short, id as hex) of a line with a marker."""
    rx = r"\[bisect-match (0x[0-9a-f]{1,16}|[01]{1,64})\]"
    return F.struct(F.regexp_replace(line, rx, "").alias("short"), F.regexp_extract(line, rx, 1).alias("id"))


# markup


def limit_newlines(s: Column) -> Column:
    return F.regexp_replace(s, "\n\n+", "\n\n")


def unwrap(s: Column) -> Column:
    """Joins wrapped lines, paragraph breaks kept."""
    return F.replace(F.regexp_replace(F.regexp_replace(s, "\n\n+", "\u0001"), "\n", " "), F.lit("\u0001"), F.lit("\n\n"))


def inline_links(s: Column) -> Column:
    """``[[url][label]]`` and ``[[url]]`` -> anchors."""
    labelled = F.regexp_replace(s, r"\[\[([^\]\[]+)\]\[([^\]\[]+)\]\]", '<a href="$1">$2</a>')
    return F.regexp_replace(labelled, r"\[\[([^\]\[]+)\]\]", '<a href="$1">$1</a>')


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def style(s: Column) -> Column:
    """``*bold*``, ``_italic_`` and back-quoted code at word borders, HTML elsewhere escaped."""
    out = html_escape(s)
    for mark, tag in ((r"\*", "b"), ("_", "i"), ("`", "code")):
        out = F.regexp_replace(out, rf"(?<![A-Za-z0-9]){mark}([^\s{mark}](?:[^{mark}]*[^\s{mark}])?){mark}(?![A-Za-z0-9])", f"<{tag}>$1</{tag}>")
    return out


def human_list(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(names)
    return (
        F.when(n == 0, "").when(n == 1, F.element_at(names, 1)).when(n == 2, F.concat_ws(" and ", names))
        .otherwise(F.concat(F.concat_ws(", ", F.slice(names, F.lit(1), n - 1)), F.lit(", and "), F.element_at(names, -1)))
    )


def parse_time(s: Column) -> Column:
    """``15:04 2 Jan 2006``; a date alone stands for eleven o'clock."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("HH:mm d MMM yyyy")), F.try_to_timestamp(s, F.lit("d MMM yyyy")) + F.expr("INTERVAL 11 HOURS"))


def needs_header(path: Column, text: Column, header: str) -> Column:
    """Whether a file lacks the required header: generated files and other kinds are passed over.

    Header and mark of generation count in any comment before the first code, however long the comments are.
    """
    source = path.rlike(r"\.(go|py|s)$") & ~path.rlike(r"(^|/)(testdata|vendor)/")
    # each match begins where the last one ended, so none is behind code
    head = F.array_join(F.regexp_extract_all(text, F.lit(r"\G\s*+(?://[^\n]*+|#[^\n]*+|/\*(?s:.*?)\*/)"), F.lit(0)), "")
    return source & ~head.rlike(r"(?m)^(//|#) Code generated .* DO NOT EDIT\.$") & ~F.contains(head, F.lit(header))


def text_of_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, entities decoded, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def directives(fmt: Column) -> Column:
    """Verbs of a printf format, flags and widths included."""
    return F.filter(F.regexp_extract_all(fmt, F.lit(r"%[-+# 0]*(?:\[[0-9]+\])?(?:[0-9]+|\*)?(?:\.(?:[0-9]+|\*)?)?(?:\[[0-9]+\])?[A-Za-z%]"), F.lit(0)), lambda d: d != "%%")


def fnv64(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> int | None:
        if x is None:
            return None
        h = 14695981039346656037
        for b in x.encode():
            h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >= 1 << 63 else h

    return s.map(one).astype("Int64")


def fnv_hash(s: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as a signed long."""
    return F.pandas_udf(fnv64, "long")(s)
