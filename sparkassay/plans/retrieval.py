"""Retrieval queries: vectors, sparse terms, keyword ranking, fusion, schema linking and knowledge-base search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions.vectors import cosine, rescaled
from sparkassay.operators import chunking, retrieval
from sparkassay.operators.features import hash_embed
from sparkassay.operators.relational import attach
from sparkassay.plans.fixtures import CATALOG, CATALOG_QUESTIONS, PASSAGES
from sparkassay.plans.registry import plain, query
from sparkassay.plans.text import DOCS, o_packed, o_tokens, o_vectors
from sparkassay.operators.vector_index import VectorIndex
from sparkassay.session import materialize, scratch_path
from sparkassay.sources.catalog import schema_block, table_name

P = plain(PASSAGES)


def o_rank(scored: str, k: int, q: str, i: str) -> str:
    """Top-k over a relation (q, i, score) whose score is already rounded."""
    return f"""SELECT {q}, CAST(rank AS INT) AS rank, {i}, score FROM (
      SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {i}) AS rank FROM ({scored})) WHERE rank <= {k}"""


def o_dense(queries: str, items: str, k: int, q: str, i: str) -> str:
    """CTE list ending in ``dense`` for hashed vectors of two (key, text) sources."""
    return f"""{o_vectors(queries, q, name='qv')}, {o_vectors(items, i, name='iv')},
    dot AS (SELECT {q}, {i}, sum(qv.w * iv.w) AS s FROM qv JOIN iv USING (b) GROUP BY ALL),
    dense AS ({o_rank(f'''SELECT a.{q}, c.{i}, round(coalesce(s, 0), 6) AS score FROM ({queries}) a CROSS JOIN ({items}) c
      LEFT JOIN dot ON dot.{q} = a.{q} AND dot.{i} = c.{i}''', k, q, i)})"""


def o_sparse(queries: str, items: str, k: int, q: str, i: str) -> str:
    return f"""qt AS (SELECT {q}, t, count(*) AS w FROM (SELECT {q}, unnest({o_tokens('text')}) AS t FROM ({queries})) GROUP BY ALL),
    it AS (SELECT {i}, t, count(*) AS w FROM (SELECT {i}, unnest({o_tokens('text')}) AS t FROM ({items})) GROUP BY ALL),
    sparse AS ({o_rank(f'SELECT {q}, {i}, CAST(sum(qt.w * it.w) AS DOUBLE) AS score FROM qt JOIN it USING (t) GROUP BY ALL', k, q, i)})"""


def o_bm25(queries: str, items: str, k: int, q: str, i: str) -> str:
    return f"""bq AS (SELECT DISTINCT {q}, unnest({o_tokens('text')}) AS t FROM ({queries})),
    bi AS (SELECT {i}, t, count(*) AS tf FROM (SELECT {i}, unnest({o_tokens('text')}) AS t FROM ({items})) GROUP BY ALL),
    bl AS (SELECT {i}, len({o_tokens('text')}) AS dl FROM ({items})),
    bs AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS al FROM bl),
    bd AS (SELECT t, count(*) AS df FROM bi GROUP BY t),
    bm25 AS ({o_rank(f'''SELECT {q}, {i}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score
      FROM bq JOIN bi USING (t) JOIN bd USING (t) JOIN bl USING ({i}) CROSS JOIN bs GROUP BY ALL''', k, q, i)})"""


def o_fused(k: int, q: str, i: str) -> str:
    return f"""fused AS ({o_rank(f'''SELECT {q}, {i}, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 6) AS score
      FROM (SELECT {q}, {i}, rank FROM dense UNION ALL SELECT {q}, {i}, rank FROM sparse) GROUP BY ALL''', k, q, i)})"""


@query("cosine", """
SELECT a.vec_id, b.vec_id AS next_id,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
     * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine(wh):
    a = wh.embeddings.select("vec_id", F.col("embedding").alias("va"))
    b = wh.embeddings.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("vb"))
    pairs = a.join(b, F.col("next_id") == F.col("vec_id") + 1)
    return pairs.select("vec_id", "next_id", F.round(cosine("va", "vb"), 6).alias("score"))


O_VEC = """SELECT a.vec_id AS query_id, b.vec_id AS item_id,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
     * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score
FROM embeddings a CROSS JOIN embeddings b"""
O_VEC5 = o_rank(O_VEC, 5, "query_id", "item_id")


def vectors(wh):
    return wh.embeddings.select("vec_id", "embedding")


@query("topk_dense", O_VEC5)
def q_topk_dense(wh):
    v = vectors(wh)
    return retrieval.topk_dense(v, v, 5, "vec_id", "vec_id")


@query("score_rescaled", f"""
SELECT query_id, rank, item_id, score, round(1 - (1 - score) / 2, 7) AS store_score FROM ({O_VEC5})""")
def q_score_rescaled(wh):
    v = vectors(wh)
    hits = retrieval.topk_dense(v, v, 5, "vec_id", "vec_id")
    return hits.withColumn("store_score", F.round(rescaled(F.col("score")), 7))


@query("vector_index", O_VEC5)
def q_vector_index(wh):
    """Two versions hold the table; queries of any number meet stored blocks."""
    v = vectors(wh)
    index = VectorIndex(wh.spark, scratch_path(wh.spark, "vector-index"), "vec_id")
    early = F.coalesce(F.col("vec_id") <= v.agg(F.avg("vec_id")).scalar(), F.lit(False))
    index.add(v.filter(early))
    index.add(v.filter(~early))
    return index.query(v, "vec_id", 5, max_rows=0)


@query("topk_ann")
def q_topk_ann(wh):
    v = vectors(wh)
    return retrieval.topk_ann(v, v, 5, "vec_id", "vec_id", dim=64)


@query("topk_ann_recall", """
SELECT (SELECT count(*) FROM embeddings) AS n_queries, true AS reached""")
def q_topk_ann_recall(wh):
    """Whether nine tenths of all exact neighbours are found."""
    v = vectors(wh)
    exact = retrieval.topk_dense(v, v, 5, "vec_id", "vec_id").select("query_id", "item_id")
    near = retrieval.topk_ann(v, v, 5, "vec_id", "vec_id", dim=64).select("query_id", "item_id", F.lit(1).alias("found"))
    return exact.join(near, ["query_id", "item_id"], "left").agg(
        F.count_distinct("query_id").alias("n_queries"),
        (F.sum(F.coalesce("found", F.lit(0))) >= 0.9 * F.count("*")).alias("reached"))


def passages(wh):
    return wh.sql(PASSAGES)


def docs(wh):
    return wh.spread("documents").select("doc_id", "text")


IDS = {"q_out": "qid", "i_out": "doc_id"}


@query("topk_hashed", f"WITH {o_dense(P, DOCS, 5, 'qid', 'doc_id')} SELECT * FROM dense")
def q_topk_hashed(wh):
    return retrieval.topk_dense(hash_embed(passages(wh)), hash_embed(docs(wh)), 5, "qid", "doc_id", **IDS)


@query("topk_sparse_dot", f"WITH {o_sparse(P, DOCS, 5, 'qid', 'doc_id')} SELECT * FROM sparse")
def q_topk_sparse_dot(wh):
    return retrieval.topk_sparse_dot(passages(wh), docs(wh), 5, "qid", "doc_id", **IDS)


@query("topk_bm25", f"WITH {o_bm25(P, DOCS, 5, 'qid', 'doc_id')} SELECT * FROM bm25")
def q_topk_bm25(wh):
    return retrieval.topk_bm25(passages(wh), docs(wh), 5, "qid", "doc_id", **IDS)


@query("rrf_hybrid", f"""
WITH {o_dense(P, DOCS, 5, 'qid', 'doc_id')}, {o_sparse(P, DOCS, 5, 'qid', 'doc_id')}, {o_fused(5, 'qid', 'doc_id')}
SELECT * FROM fused""")
def q_rrf_hybrid(wh):
    return retrieval.topk_hybrid(hash_embed(passages(wh)), hash_embed(docs(wh)), 5, "qid", "doc_id", **IDS)


CQ = f"SELECT qid, question AS text FROM ({plain(CATALOG_QUESTIONS)})"
CI = f"SELECT pos, table_def AS text FROM ({plain(CATALOG)})"
O_LINK = f"""{o_dense(CQ, CI, 5, 'qid', 'pos')}, {o_sparse(CQ, CI, 5, 'qid', 'pos')}, {o_fused(5, 'qid', 'pos')}"""


def link(wh, how: str, k: int = 5):
    """Top-k table definitions per catalogue question."""
    # Keyword search reads no vectors; others read them more than once, and then without the tasks that made them.
    features = (lambda df, label: df) if how == "sparse" else (lambda df, label: materialize(hash_embed(df), label))
    q = features(wh.sql(CATALOG_QUESTIONS).select("qid", F.col("question").alias("text")), "questions")
    i = features(wh.sql(CATALOG, spread=True).withColumnRenamed("table_def", "text"), "definitions")
    return retrieval.retrieve(q, i, how, k, "qid", "pos", q_out="qid", i_out="pos")


def linked(wh, how: str, k: int = 5):
    """The same with the definition text."""
    return attach(link(wh, how, k), wh.sql(CATALOG), "pos")


def o_blocks(how: str, cte: str) -> str:
    return f"""SELECT '{how}' AS how, qid, 'Database schema' || chr(10) || chr(10) || 'Tables:' || chr(10)
      || string_agg('  ' || text, chr(10) ORDER BY rank) AS schema_block,
      string_agg(trim(split_part(text, '(', 1)), ',' ORDER BY rank) AS tables
    FROM {cte} JOIN ({CI}) USING (pos) GROUP BY qid"""


@query("retrieve_schema", f"""
WITH {O_LINK} {o_blocks('dense', 'dense')} UNION ALL {o_blocks('sparse', 'sparse')} UNION ALL {o_blocks('hybrid', 'fused')}""")
def q_retrieve_schema(wh):
    # The fused list is built from the two ranked lists, which are written once and shared.
    dense, sparse = (materialize(link(wh, how), how) for how in ("dense", "sparse"))
    lists = {"dense": dense, "sparse": sparse, "hybrid": retrieval.rrf([dense, sparse], 5, "qid", "pos")}
    hits = None
    for how, ranked in lists.items():
        tagged = ranked.withColumn("how", F.lit(how))
        hits = tagged if hits is None else hits.unionByName(tagged)
    hits = attach(hits, wh.sql(CATALOG), "pos")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "table_def"))),
                                     lambda s: table_name(s["table_def"])), ",")
    return schema_block(hits, ["how", "qid"], "rank", tables=names)


def o_context(hits: str, queries: str, text: str, source: str) -> str:
    """Rendered context from a relation (qid, rank, score, text, source)."""
    return f"""SELECT q.qid, coalesce(string_agg('[' || rank || '] (source: ' || {source} || ', score: '
        || CAST(CAST(round(CAST(score AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS STRING) || ')' || chr(10) || {text},
        chr(10) || chr(10) ORDER BY rank), 'No relevant context found.') AS context
      FROM ({queries}) q LEFT JOIN ({hits}) h ON h.qid = q.qid GROUP BY q.qid"""


@query("context_block", f"""
WITH {o_bm25(P, DOCS, 3, 'qid', 'doc_id')}
{o_context("SELECT bm25.*, d.text AS body, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS src FROM bm25 JOIN documents d USING (doc_id)",
           P, 'body', "coalesce(src, 'unknown')")}""")
def q_context_block(wh):
    hits = retrieval.topk_bm25(passages(wh), docs(wh), 3, "qid", "doc_id", **IDS)
    bodies = wh.documents.select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("src"))
    return retrieval.context_block(passages(wh), "qid", attach(hits, bodies, "doc_id"), F.col("src"))


O_CHUNKS = "SELECT CAST(doc_id AS STRING) || ':' || CAST(chunk_index AS STRING) AS chunk_id, text FROM packed"


@query("kb_search", f"""
WITH RECURSIVE {o_packed(DOCS, 400, 1)}, {o_dense(P, O_CHUNKS, 3, 'qid', 'chunk_id')}
{o_context(f"SELECT dense.*, c.text AS body, source FROM dense JOIN ({O_CHUNKS}) c USING (chunk_id) JOIN documents d ON CAST(d.doc_id AS STRING) = split_part(chunk_id, ':', 1)",
           P, 'body', 'source')}""")
def q_kb_search(wh):
    chunks = (chunking.chunk_sentence(wh.spread("documents").select("doc_id", "source", "text"), max_size=400, overlap=1)
              .select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "text", "source"))
    # Chunks are cut and hashed once, for the search and for their texts.
    index = VectorIndex(wh.spark, scratch_path(wh.spark, "kb"), "chunk_id")
    index.add(hash_embed(chunks))
    hits = index.query(hash_embed(passages(wh)), "qid", 3, q_out="qid", i_out="chunk_id")
    found = attach(hits, index.rows().select("chunk_id", "text", "source"), "chunk_id")
    return retrieval.context_block(passages(wh), "qid", found, F.col("source"))
