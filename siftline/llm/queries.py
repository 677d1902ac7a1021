"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, filter_audit, jaccard_join, langid, mixing, packing, quality, secret_scan, shared, simhash, token_counts, warc, whitening


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(shared.documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(shared.documents(spark, sf_dir))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = shared.pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return chat.conversation_digests(turns.unionByName(chat.conflicting_conversation(spark)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(shared.documents(spark, sf_dir))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(shared.documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(shared.documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(shared.documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(shared.documents(spark, sf_dir))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_orders(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(shared.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_source_mixing": op5_source_mixing,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        ), g AS (
          SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
        )
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
    "op4_chat_formatting": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), m AS (
          SELECT *,
            length(text) + len(regexp_extract_all(text, '[\[<]\\*(?:s>|/s>|INST\]|/INST\]|ROLE\]|SEP\]|/ROLE\])'))
            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 22 + length(role) END AS chars
          FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
          (sum(chars) + 3)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op6_warc_round_trip": r"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
        ), g AS (
          SELECT html, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY html
        )
        SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
          CASE WHEN g.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN g.keeper <> p.page_id THEN g.keeper END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html
    """,
    "op9_quality_rules": quality.SQL,
    "op11_filter_interaction_audit": filter_audit.SQL,
    "op13_ngram_jaccard_join": jaccard_join.SQL,
}
