"""Personal data and the terms that give it away, in DataFrame operations only.

Base spans (emails, addresses, cards, phones) are found by pattern and checked.
The method then protects them against inference: over the whole corpus it
counts in how many texts a term occurs together with a protected entity against
how many hold either.  The pointwise mutual information of term and entity, as
a share of the entity's information content, says how far the term discloses
it; a term over the threshold is generalised wherever it stands, in texts
without the entity too, and one that all but names it is removed.  One text, or
copies and near copies of one, prove nothing: a pair counts only if the term
stands between as many different neighbours as half the texts that hold both.

Patterns are written so that no text makes them slow or deep: a run is entered
only where it begins or the last match ended, and repetition is possessive;
both leave the leftmost longest matches as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, hot_split_lookup, materialise, texts

KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Distinct neighbourhoods (the words on both sides) and distinct texts in which a term must stand with an entity, and distinct
#: neighbourhoods a text; share of the entity's information at which a term is generalised, and removed.
SUPPORT, INDEPENDENT, GENERALISE, REMOVE = 2, 0.5, 0.8, 0.95
#: A term: letters and digits, two at least.
_WORD = r"[\p{L}\p{N}]++"


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum is a multiple of ten."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda k: _doubled(F.substring(back, k, F.lit(1)).cast("int"), k % 2 == 0))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(d: Column, even: Column) -> Column:
    return F.when(even, F.when(d >= 5, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def valid(kind: Column, value: Column) -> Column:
    """The check each kind's match must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    card = F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == 1, value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == 2, card)
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def matches(whole: DataFrame) -> DataFrame:
    """(key, copies, kind, idx, gap, value) per pattern match of every distinct text.

    ``gap`` is the length between the last match's end and this one's start.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")
    guards = (F.contains(text, F.lit("@")), digit & F.contains(text, F.lit(".")), digit, F.contains(text, F.lit("+")))
    found = whole.select("text", *[F.when(g, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(k) for g, p, k in zip(guards, PATTERNS, KINDS)])
    some = found.where(" OR ".join(f"size({k}) > 0" for k in KINDS)).withColumn("key", F.md5("text"))
    parts = [F.when(F.size(k) > 0, F.split(text, p, -1)) for p, k in zip(PATTERNS, KINDS)]
    each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("m"), p.alias("p")) for i, (k, p) in enumerate(zip(KINDS, parts))])
    rows = some.select("key", F.explode(each).alias("e")).where("size(e.m) > 0").select("key", "e.kind", "e.p", F.posexplode("e.m").alias("idx", "value"))
    flat = rows.select("key", "kind", "idx", "value", F.length(F.get("p", F.col("idx"))).alias("gap"))
    # texts with one key are equal, so their matches are: one row for all copies
    return flat.groupBy("key", "kind", "idx").agg(*[F.first(c).alias(c) for c in ("gap", "value")], F.count(F.lit(1)).alias("copies"))


def base_spans(found: DataFrame) -> DataFrame:
    """(key, copies, kind, start, stop, entity): checked matches with code-point offsets, stop exclusive."""
    so_far = Window.partitionBy("key", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value")
    start = F.sum(F.col("gap") + size).over(so_far) - size
    placed = found.withColumns({"start": start.cast("long"), "stop": (start + size).cast("long")}).where(valid(F.col("kind"), F.col("value")))
    plain = F.when(F.col("kind") == 0, F.lower("value")).when(F.col("kind") == 1, F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    return placed.withColumn("entity", F.md5(F.concat(F.col("kind").cast("string"), F.lit(":"), plain))).drop("value", "gap", "idx")


def terms(texts_: DataFrame) -> DataFrame:
    """(key, copies, term, start, stop, around) per term of ``texts_ (key, copies, text)``; ``around`` hashes its neighbours."""
    split = texts_.select("key", "copies", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("m"), F.split("text", _WORD, -1).alias("p")).where("size(m) > 0")
    each = split.select("key", "copies", "p", "m", F.posexplode("m").alias("i", "word"))
    near = F.xxhash64(F.lower(F.get("m", F.col("i") - 1)), F.lower(F.get("m", F.col("i") + 1)))
    flat = each.select("key", "copies", "i", "word", near.alias("around"), F.length(F.get("p", F.col("i"))).alias("gap"))
    so_far = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("word")
    stop = F.sum(F.col("gap") + size).over(so_far)
    placed = flat.select("key", "copies", F.lower("word").alias("term"), (stop - size).cast("long").alias("start"), stop.cast("long").alias("stop"), "around")
    return placed.where("stop - start >= 2")


def keyed_texts(whole: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, copies, text): the distinct texts whose key is in ``keys (key)``."""
    some = whole.select(F.md5("text").alias("key"), "text").join(broadcast_if_small(keys), "key", "left_semi")
    return some.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))


def held_terms(whole: DataFrame) -> DataFrame:
    """(key, term) per row of ``whole`` and distinct term of its text."""
    return whole.select(F.md5("text").alias("key"), F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))


def disclosing(whole: DataFrame, spans: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(term, disclosure): terms at or over the threshold for some entity, with the largest share of information.

    All three counts are of rows whose whole text holds the entity, the term,
    or both.  Only entities of several texts can have pairs with support, so
    only these texts are taken apart; a frequent entity's rows are added up by
    neighbourhood first.
    """
    held = spans.select("entity", "key", "copies").distinct()
    entities = materialise(held.groupBy("entity").agg(F.sum("copies").alias("df_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support))
    nothing = entities.select(F.lit("").alias("term"), F.lit(0.0).alias("disclosure")).limit(0)
    if entities.isEmpty():
        return nothing
    repeated = materialise(hot_split_lookup(held, entities, "entity", "texts", ["key"]).where("df_e is not null").select("entity", "key"))
    found = materialise(terms(keyed_texts(whole, repeated.select("key").distinct())).groupBy("key", "copies", "term").agg(F.min("around").alias("least")))
    # copies and near copies have the same words around a term but where an edit happens to be beside it
    each = repeated.join(found, "key").groupBy("entity", "term", "least").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts"))
    pairs = each.groupBy("entity", "term").agg(F.sum("both").alias("both"), F.sum("texts").alias("texts"), F.count(F.lit(1)).alias("around"))
    pairs = materialise(pairs.where((F.col("texts") >= support) & (F.col("around") >= F.greatest(F.lit(support), F.col("texts") * INDEPENDENT))).select("entity", "term", "both"))
    if pairs.isEmpty():
        return nothing
    wanted = materialise(pairs.select("term").distinct())
    df = materialise(held_terms(whole).join(broadcast_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    n = float(whole.count())
    information = F.log2(F.lit(n) / F.col("df_e"))
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("df") * F.col("df_e")))
    joined = pairs.join(broadcast_if_small(entities), "entity").join(broadcast_if_small(df), "term")
    scored = joined.withColumn("disclosure", F.when(information > 0, pmi / information).otherwise(0.0))
    return scored.where(F.col("disclosure") >= threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def all_spans(whole: DataFrame) -> DataFrame:
    """(key, copies, kind, start, stop, mask): base spans and, as kind 4, disclosing terms, per distinct text."""
    spans = materialise(base_spans(matches(whole)))
    telling = materialise(disclosing(whole, spans))
    base = spans.select("key", "copies", "kind", "start", "stop", F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), F.lit("]")).alias("mask"))
    if telling.isEmpty():
        return base
    keys = materialise(held_terms(whole).join(broadcast_if_small(telling), "term", "left_semi").select("key").distinct())
    hit = terms(keyed_texts(whole, keys)).join(broadcast_if_small(telling), "term")
    masked = hit.select("key", "copies", F.lit(4).alias("kind"), "start", "stop", F.when(F.col("disclosure") >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("mask"))
    # a term inside a base span is covered by it
    order = Window.partitionBy("key").orderBy("start", "kind", "stop")
    is_base = F.col("kind") < 4
    behind = F.max(F.when(is_base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = base.unionByName(masked).withColumns({"__behind": behind, "__ahead": ahead})
    free = (F.coalesce("__behind", F.lit(0)) <= F.col("start")) & (F.coalesce("__ahead", F.col("stop")) >= F.col("stop"))
    return placed.where(is_base | free).drop("__behind", "__ahead")


def _listed(kinds: int) -> Column:
    """Spans of the first kinds as kind:start:end by kind and start."""
    names = F.array(*map(F.lit, (*KINDS, "term")))
    own = F.filter("spans", lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def per_text(whole: DataFrame) -> DataFrame:
    """(key, copies, spans): one row per distinct text with spans, as structs sorted by kind and start."""
    found = all_spans(whole)
    return found.groupBy("key").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("kind", "start", "stop", "mask"))).alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    A null or empty text has no spans; long texts are read whole.  Rows that
    repeat, ids that are null or repeat, and tables without personal data are
    answered row by row, an empty table with no row; further columns are passed
    over.  ``n_term`` is 0 where no entity occurs in texts that aren't copies.
    """
    whole = texts(docs, id_col, text_col)
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    digest = per_text(whole).select(
        "key", "copies", *[count(i).alias(f"n_{k}") for i, k in enumerate((*KINDS, "term"))], F.sha2(_listed(4), 256).alias("base_sha256"), _listed(5).alias("listed")
    )
    rows = hot_split_lookup(whole.select("doc_id", F.md5("text").alias("key")), materialise(digest), "key", "copies", ["doc_id"])
    zero = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in (*KINDS, "term")]
    return rows.select("doc_id", *zero[:4], F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("listed", F.lit("")).alias("spans"), zero[4])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every text with base spans replaced by their kind and disclosing terms generalised or removed.

    Of spans that overlap the one that begins first is replaced, and what
    stands behind it of the others is replaced with it.
    """
    whole = texts(docs, id_col, text_col).withColumn("key", F.md5("text"))
    found = all_spans(whole.select("doc_id", "text"))
    order = Window.partitionBy("key").orderBy("start", F.desc("stop"), "kind")
    behind = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = found.withColumn("from", behind).where("stop > from")
    piece = F.struct("start", "from", "stop", F.when(F.col("start") >= F.col("from"), F.col("mask")).otherwise("").alias("mask"))
    table = materialise(cut.groupBy("key").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(piece)).alias("cuts")))
    rows = hot_split_lookup(whole, table, "key", "copies", ["doc_id"])
    text = F.col("text")
    kept = F.transform("cuts", lambda c: F.concat(F.substring(text, (c["from"] + 1).cast("int"), F.greatest(c["start"] - c["from"], F.lit(0)).cast("int")), c["mask"]))
    rest = F.substring(text, (F.element_at("cuts", -1)["stop"] + 1).cast("int"), F.length(text))
    return rows.select("doc_id", F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest)).alias("text"))
