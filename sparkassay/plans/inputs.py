"""Source, sink and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import chunking, results
from sparkassay.plans.fixtures import CATALOG, QUESTIONS
from sparkassay.plans.registry import plain, query
from sparkassay.plans.text import DOCS, o_lines
from sparkassay.session import scratch_path
from sparkassay.sources import catalog, tables

Q, C = plain(QUESTIONS), plain(CATALOG)


@query("load_questions", f"SELECT CAST(qid AS VARCHAR) AS id, difficulty, question, sql, '' AS notes FROM ({Q}) WHERE difficulty = 'hard'")
def q_load_questions(wh):
    path = scratch_path(wh.spark, "questions")
    lines = wh.sql(QUESTIONS).select(F.col("qid").cast("string").alias("id"), "difficulty", "question", "sql")
    lines.write.json(path)
    return tables.load_questions(wh.spark, path, "hard", multi_line=False).drop("expected_rows")


@query("golden_rows", f"SELECT CAST(qid AS VARCHAR) AS id, CAST(0 AS INT) AS row_no, 'n:' || qid || '.00|s:' || difficulty || '|n:1.50' AS cells FROM ({Q})")
def q_golden_rows(wh):
    path = scratch_path(wh.spark, "golden")
    rows = F.concat(F.lit("[["), F.col("qid").cast("string"), F.lit(',"'), F.col("difficulty"), F.lit('",1.5]]'))
    (wh.sql(QUESTIONS).select(F.concat(F.lit('{"id":"'), F.col("qid").cast("string"), F.lit('","expected_rows":'), rows, F.lit("}")).alias("value"))
     .write.text(path))
    loaded = tables.load_questions(wh.spark, path, multi_line=False)
    return tables.expected_cells(loaded).withColumn("cells", F.array_join("cells", "|", "null"))


@query("load_documents", """
SELECT lang, true AS named, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def q_load_documents(wh):
    path = scratch_path(wh.spark, "texts")
    # Each file becomes one document when read back; the cap bounds a file's size, not the rows written.
    (wh.documents.select("lang", "text").write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(path))
    docs = tables.load_documents(wh.spark, path)
    named = F.col("metadata")["source"].endswith(".txt") & F.col("metadata")["path"].contains("/lang=")
    return docs.groupBy(F.regexp_extract(F.col("metadata")["path"], r"/lang=([^/]*)/", 1).alias("lang")).agg(
        F.bool_and(named).alias("named"), F.sum(F.length("text")).alias("n_chars"))


@query("docs_from_texts", "SELECT item_id, text, 'unknown' AS source FROM benchmark")
def q_docs_from_texts(wh):
    return tables.docs_from_texts(wh.benchmark).select("item_id", "text", F.col("metadata")["source"].alias("source"))


STAR = ("customer", "part", "orders", "lineitem")


@query("load_star", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in STAR))
def q_load_star(wh):
    target = scratch_path(wh.spark, "star")
    tables.save_star(wh, target, STAR)
    tables.save_star(wh, target, STAR)  # a second load without force leaves the tables alone
    copy = tables.Warehouse(wh.spark, target)
    counts = [getattr(copy, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in STAR]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("index_append", f"SELECT 2 * count(*) AS n_chunks FROM ({o_lines(DOCS)})")
def q_index_append(wh):
    index = tables.ChunkIndex(wh.spark, scratch_path(wh.spark, "index"))
    chunks = chunking.chunk_lines(wh.spread("documents").select("doc_id", "text"))
    index.add(chunks)
    index.add(chunks)  # appended again: the index does not remove duplicates
    return index.count()


@query("index_reset", f"SELECT count(*) AS n_chunks FROM ({o_lines(DOCS)})")
def q_index_reset(wh):
    index = tables.ChunkIndex(wh.spark, scratch_path(wh.spark, "index"))
    chunks = chunking.chunk_lines(wh.spread("documents").select("doc_id", "text"))
    index.add(chunks)
    index.reset(chunks)
    index.add(chunks)
    return index.count()


@query("schema_catalog", f"SELECT pos, trim(split_part(table_def, '(', 1)) AS table_name, table_def FROM ({C})")
def q_schema_catalog(wh):
    return catalog.with_names(wh.sql(CATALOG)).select("pos", "table_name", "table_def")


@query("schema_lookup", f"SELECT pos, table_def FROM ({C}) WHERE trim(split_part(table_def, '(', 1)) = 'red_widget_1'")
def q_schema_lookup(wh):
    return catalog.lookup(wh.sql(CATALOG), "RED_WIDGET_1").select("pos", "table_def")


# One block per catalogue; here the tables whose names begin alike are one.
@query("render_schema_block", f"""
SELECT split_part(table_def, '_', 1) AS family, 'Database schema' || chr(10) || chr(10) || 'Tables:' || chr(10) || string_agg('  ' || table_def, chr(10) ORDER BY pos)
  || chr(10) || chr(10) || 'Relationships:' || chr(10) || '  a.id -> b.id' AS schema_block
FROM ({C}) GROUP BY 1""")
def q_render_schema_block(wh):
    named = wh.sql(CATALOG).withColumn("family", F.split_part("table_def", F.lit("_"), F.lit(1)))
    return catalog.schema_block(named, ["family"], "pos", relationships=["a.id -> b.id"])


@query("records_null_filled", """
SELECT o_orderkey, '{"o_orderstatus":"' || coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, '') || '","o_custkey":"' || o_custkey || '"}' AS record FROM orders""")
def q_records_null_filled(wh):
    rows = wh.orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    return results.records_null_filled(rows, ["o_orderkey"], ["o_orderstatus", "o_custkey"])
