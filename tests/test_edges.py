"""Nulls in every text and vector operator, deep and bracketed statements, line breaks, and conversations that succeed early."""

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import difficulty, screening, vectors
from sparkassay.operators import chunking, prompts, retrieval
from sparkassay.session import shared_dir


@pytest.mark.parametrize("sql, category", [
    ("SELECT * FROM (secrets s JOIN vault v ON s.id = v.id)", "schema_violation"),
    ("SELECT * FROM orders JOIN (vault v JOIN secrets s ON s.a = v.a) ON true", "schema_violation"),
    ("SELECT * FROM (orders o JOIN customers c ON o.id = c.id)", None),
    ("SELECT " + "(" * 20 + "1" + ")" * 20 + " FROM orders", None),
    ("SELECT trim(lower(x) FROM name) FROM orders", None),
    ("SELECT ((1) FROM orders", "disallowed_statement"),
])
def test_statement_audit(spark, sql, category):
    df = spark.createDataFrame([(sql,)], "sql string")
    assert df.select(screening.check_output("sql")["category"]).first()[0] == category


def test_null_texts_and_vectors(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: sum(r.v) > 0 for r in docs.select("doc_id", vectors.hash_vector("text").alias("v")).collect()} == {
        1: True, 2: False, 3: False}
    assert {r.doc_id for r in chunking.chunk_sentence(docs).collect()} == {1}
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "iid long, v array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "qid long, v array<double>")
    hits = retrieval.topk_dense(asked.withColumnRenamed("v", "embedding"), items.withColumnRenamed("v", "embedding"), 2, "qid", "iid",
                                q_out="qid", i_out="iid").collect()
    assert {(r.qid, r.iid) for r in hits} == {(7, 1), (7, 3)}


def test_line_breaks_do_not_end_a_rule(spark):
    df = spark.createDataFrame([("Top 5 customers\rby revenue",), ("Top 5 customers by revenue",)], "q string")
    grades = {tuple(r.g) for r in df.select(difficulty.rule_grade(F.lower("q")).alias("g")).collect()}
    assert len(grades) == 1


def test_retry_stops_at_first_success(spark):
    log = spark.createDataFrame([(1, 1, "a", "bad"), (1, 2, "b", None), (1, 3, "c", "late")], "q long, attempt int, sql string, error string")
    out = prompts.retry_messages(log.withColumn("raw", F.col("sql")), "q").select(prompts.show_messages(F.col("turns"))).first()[0]
    assert "late" not in out and out.endswith("assistant>b")


def test_local_scratch_only_on_a_local_master(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = {}

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
    with pytest.raises(ValueError):
        shared_dir(Session())
