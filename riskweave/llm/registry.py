"""The thin queries over the given tables, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from riskweave.llm.alignment import alignment
from riskweave.llm.common import table
from riskweave.llm.editwalk import edited_fingerprints
from riskweave.llm.langid import identify
from riskweave.llm.leaks import contamination
from riskweave.llm.leaks import oracle_sql as contamination_sql
from riskweave.llm.licences import oracle_sql as licence_sql
from riskweave.llm.licences import scan
from riskweave.llm.packing import pack
from riskweave.llm.pages import main_text
from riskweave.llm.pii import pseudonym_texts
from riskweave.llm.repeats import repeat_digest
from riskweave.llm.simhash import near_duplicates
from riskweave.llm.trie import oracle_sql as trie_sql
from riskweave.llm.trie import prefix_trie
from riskweave.llm.vectors import near_vectors
from riskweave.llm.viterbi import encoding_digest


def op1_feistel_pseudonyms(spark, sf_dir):
    return pseudonym_texts(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op3_sentencepiece_scan(spark, sf_dir):
    return encoding_digest(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_document_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark, sf_dir):
    return repeat_digest(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece_scan": op3_sentencepiece_scan,
    "op4_license_scan": op4_license_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scan": licence_sql(),
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM v
  UNION
  SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.other) AS component_id, v.vec_id = min(r.other) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN reach r ON r.node = v.vec_id GROUP BY v.vec_id
""",
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(len(words) - 19)) AS k,
    unnest(list_transform(range(len(words) - 19), lambda k: md5(array_to_string(words[k + 1:k + 20], ' ')))) AS key FROM w WHERE len(words) >= 20
), h AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY key ORDER BY doc_id, k) AS nth FROM s
), gone AS (
  SELECT DISTINCT doc_id, k + j AS p FROM h, (SELECT unnest(range(20)) AS j) WHERE nth > 1
), kept AS (
  SELECT u.doc_id, u.p, u.x FROM (SELECT doc_id, unnest(range(len(words))) AS p, unnest(words) AS x FROM w WHERE doc_id IN (SELECT doc_id FROM gone)) u
  ANTI JOIN gone g ON g.doc_id = u.doc_id AND g.p = u.p
), t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM kept GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id FROM gone)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(CASE WHEN d.doc_id IS NULL THEN 0 ELSE len(words) - coalesce(t.n, 0) END AS BIGINT) AS n_removed,
  sha256(CASE WHEN d.doc_id IS NULL THEN array_to_string(words, ' ') ELSE coalesce(t.text, '') END) AS kept_sha256
FROM w LEFT JOIN d ON d.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
""",
    "op11_conversation_trie": trie_sql(),
    "op12_benchmark_decontamination": contamination_sql(),
}
