"""Queries of the training-data operators, with production parameters, and
their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid_ecoc, license_scan, mixing, pii, quality_knn, quality_rules, simhash, substring_dedup, token_dac
from .common import read_table, scratch

TOKENIZER = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("matches")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), limit=2).select("doc_id", "fingerprint", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("text_key")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ecoc.identify_language(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs through files of token codes: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    path = scratch(spark, "tokens")
    token_dac.write_tokens(docs, tokenizer, path, end_id=2)
    out = token_dac.read_tokens(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark, read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"), *[pii.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS[4:]], F.size("spans").cast("long").alias("n_spans"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_simhash, op4_quality, op5_mixing, op6_language, op7_quality_rules, op8_token_ids, op9_decontamination, op10_pii)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = f"list_filter(regexp_split_to_array({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    v AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
    r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM v) WHERE k > 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
    c AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
    k AS (SELECT d.doc_id, w, gone, p FROM d LEFT JOIN c USING (doc_id), (SELECT 1 AS p))
    SELECT k.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
      sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[q.i], ' ' ORDER BY q.i) FROM (SELECT unnest(range(1, len(w) + 1)) AS i) q WHERE NOT list_contains(gone, q.i)), '') END) AS kept_sha256
    FROM k""",
    "op2_license_scan": license_scan.license_sql(),
    "op9_decontamination": f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
    i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
    f AS (SELECT DISTINCT n, string_split(t, ' ')[1] AS first FROM iw),
    dw AS (SELECT doc_id, s, f.n, array_to_string(w[s:s + f.n - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d) x JOIN f ON f.first = x.w[x.s] WHERE s + f.n - 1 <= len(w)),
    m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
    a AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id),
    nw AS (SELECT row_number() OVER () AS wid, item_id, t FROM (SELECT DISTINCT item_id, list_sort(list_distinct(string_split(t, ' '))) AS t FROM iw)),
    dp AS (SELECT doc_id, w[p] AS term, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
    fr AS (SELECT term, count(*) AS c FROM dp GROUP BY term),
    rare AS (SELECT wid, arg_min(term, c) AS term FROM (SELECT wid, unnest(t) AS term FROM nw) JOIN fr USING (term) GROUP BY wid),
    sp AS (SELECT DISTINCT doc_id, wid, unnest(range(greatest(p - 19, 1), p + 1)) AS s FROM dp JOIN rare USING (term)),
    nr AS (SELECT sp.doc_id, count(DISTINCT item_id) AS n_near FROM sp JOIN nw USING (wid) JOIN d ON d.doc_id = sp.doc_id WHERE list_has_all(d.w[s:s + 19], t) GROUP BY sp.doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN nr USING (doc_id)""",
}
