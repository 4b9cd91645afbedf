"""The ``opN_<name>`` queries over a data directory, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import decontamination, lm_scoring, packing, pii, simhash, token_counts, toxicity, url_filters, warc

#: Where the vocabulary files are, by name; a parameter of the operators.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
_PATTERNS = " + ".join(f"regexp_matches(lower(url), '{p}')::INT" for p in url_filters.PATTERN_RULES)


def _list_case(value: int) -> str:
    """CASE over the list rules, longest first; value 0 gives the rule, 1 its verdict."""
    whens = ""
    for rule in sorted(url_filters.LIST_RULES, key=lambda r: (-len(r[0]), r)):
        cut = rule[0].index("/")
        host, path = rule[0][:cut], rule[0][cut:]
        whens += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule[value]}'"
    return f"CASE{whens} END"


SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT *, max(CASE WHEN payload_bytes >= 1000 THEN page_id END) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM g""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOW.format("coalesce(text, '')")}) AS h FROM documents),
             g AS (SELECT doc_id, h, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                          row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) AS rn FROM d)
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM g""",
    "op10_url_filter": f"""
        WITH u AS (SELECT page_id, url, {_REST} AS rest FROM pages),
             p AS (SELECT page_id, coalesce({_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
                          coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path,
                          coalesce({_PATTERNS}, 0)::INT AS n_patterns FROM u)
        SELECT page_id, host, path, {_list_case(0)} AS rule,
               coalesce({_list_case(1)}, CASE WHEN n_patterns > 0 THEN 'block' ELSE 'allow' END) AS verdict, n_patterns FROM p""",
}
