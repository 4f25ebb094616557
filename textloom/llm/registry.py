"""Queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import license_scan, media_avi, near_dedup, packing, piece_lattice, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_piece_lattice": piece_lattice.op6_piece_lattice,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_media_avi": media_avi.op10_media_avi,
        "license_base": license_base,
        "quality_base": quality_base,
        "media_payload": media_payload,
        "packed_sums": packed_sums,
    }


WORDS = r"[^\x20\x09-\x0D]+"
#: The base of an operator, by its own columns, beside the same in SQL; what the method adds is tested by brute force in tests/llm.
NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both >= 85 * (p.n + q.n - both)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)"""
PHRASES = " UNION ALL ".join(f"SELECT '{p}' AS phrase, {len(p.split())} AS size, '{label}' AS label" for p, label in license_scan.BASE.items())
LICENSE = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), p AS ({PHRASES}),
hit AS (SELECT doc_id, label, k - 1 AS place FROM (SELECT doc_id, w, phrase, size, label, unnest(generate_series(1, len(w))) AS k FROM w, p WHERE len(w) > 0) WHERE array_to_string(w[k : k + size - 1], ' ') = phrase)
SELECT w.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS base_labels FROM w LEFT JOIN hit USING (doc_id) GROUP BY w.doc_id, w.w"""
QUALITY = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
t AS (SELECT doc_id, k, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM w WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM (SELECT doc_id, k FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), range(0, 3) x(j) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORDS}') GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""
PAYLOAD = "SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, (octet_length(b) + pad)::BIGINT AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, pad)) AS payload_sha256 FROM (SELECT doc_id, b, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END AS pad FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents))"


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_avi.op10_media_avi(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def packed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is packed, its pieces are numbered without a gap, and no sequence holds more than it may."""
    rows = packing.op9_best_fit_packing(spark, sf_dir)
    docs = rows.groupBy("doc_id").agg((F.max("piece") + 1 == F.count("*")).alias("whole"))
    fits = rows.groupBy("sequence_id").agg((F.sum("length") <= packing.CAPACITY).alias("fits")).agg(F.bool_and("fits").alias("fits"))
    return docs.crossJoin(F.broadcast(fits)).select("doc_id", "whole", "fits")


def oracle_sql() -> dict[str, str]:
    return {"op7_near_dedup": NEAR, "license_base": LICENSE, "quality_base": QUALITY, "media_payload": PAYLOAD, "packed_sums": "SELECT DISTINCT doc_id, true AS whole, true AS fits FROM documents"}
