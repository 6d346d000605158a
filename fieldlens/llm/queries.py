"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html_text, jaccard, language, lattice, license_scan, mixing, substring_dedup, warc
from .common import crc_rest, small_batches, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload", "url")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_key")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lattice.score_documents(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pivotal_mix(table(spark, sf_dir, "documents")).drop("source")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup.dedup_report(table(spark, sf_dir, "documents")).drop("kept_text", "removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), h AS (
  SELECT doc_id, i, ks.k, array_to_string(w[i:i + ks.k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0), (SELECT DISTINCT k FROM g) AS ks
  WHERE i + ks.k - 1 <= len(w)
), m AS (
  SELECT h.doc_id, h.i, h.k, g.item FROM h JOIN g ON h.gram = g.gram AND h.k = g.k
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), k AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS kind FROM s GROUP BY doc_id
), r AS (
  SELECT kind, any_value(n) AS n, min(doc_id) AS rep FROM k GROUP BY kind
), t AS (
  SELECT r.rep, gram FROM r JOIN s ON s.doc_id = r.rep
), p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS same FROM t a JOIN t b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN r x ON x.rep = a JOIN r y ON y.rep = b WHERE 100 * same >= 80 * (x.n + y.n - same)
), q AS (
  SELECT rep AS node, rep AS root FROM r UNION SELECT l.b AS node, q.root FROM q JOIN l ON l.a = q.node WHERE q.root < l.b
), c AS (
  SELECT node, min(root) AS root FROM q GROUP BY node
), m AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (kind) LEFT JOIN c ON c.node = r.rep LEFT JOIN m ON m.a = r.rep
"""

OP3_SQL = """
WITH s AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM s
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)
), f AS (
  SELECT gram, min(doc_id) AS first FROM g GROUP BY gram
), c AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS p FROM g JOIN f USING (gram) WHERE first < doc_id)
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x ANTI JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id
), n AS (
  SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op3_warc_round_trip": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op10_substring_dedup": OP10_SQL}
