"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import merkle, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.sharding import stored_digest

    return stored_digest(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.url_filter import judge, rule_table

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.fingerprints import edited_likeness

    return edited_likeness(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.decontamination import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.toxicity import rate

    return rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.suffix_dedup import digest

    return digest(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.merkle import digest

    return digest(_table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.piece_encoding import digest

    return digest(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quantloom.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


_EVERY = (
    op1_sharding, op2_best_fit_packing, op3_ngram_join, op4_url_filters, op5_fingerprints, op6_license_scans, op7_benchmark_decontamination,
    op8_toxicity, op9_language_id, op10_suffix_dedup, op11_merkle_manifest, op12_sentencepiece, op13_embedding_whitening,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _EVERY}

_SHARDING = "SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, md5(text) AS md5 FROM documents"

_NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(node, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""

#: SQL where it can express the operator; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op1_sharding": _SHARDING, "op3_ngram_join": _NGRAM_JOIN, "op4_url_filters": url_filter.ORACLE, "op11_merkle_manifest": merkle.ORACLE}
