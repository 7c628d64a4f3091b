"""The registered queries of this subpackage and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkassay.llm import alignment, bpe_count, decontam, divergence, exact, itq, langid, licence, packing, pfor, pii, simhash, warc

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_index(spark, pfor.write_token_files(_table(spark, sf_dir, "documents"), VOCABULARY))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.stored_pages(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op7_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_token_files, op3_near_vectors, op4_page_archive, op5_packing,
                            op6_personal_data, op7_contaminated, op8_simhash, op9_licences, op10_language,
                            op11_token_alignment, op12_divergence, op13_exact_dedup)
}

ORACLES: dict[str, str] = {
    # Every pair of vectors of a label is compared, in double precision, and the smallest label is passed along links.
    "op3_near_vectors": """
        WITH RECURSIVE ok AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ), reach(a, b) AS (
            SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, coalesce(deg.n, 0) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(low.m, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN deg ON e.vec_id = deg.a LEFT JOIN low ON e.vec_id = low.a
    """,
    "op4_page_archive": f"""
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
        ), d AS (
            SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p
        ), o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> owner THEN owner END AS refers_to
        FROM o
    """,
    "op12_divergence": divergence.AUDIT_SQL,
    "op13_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
