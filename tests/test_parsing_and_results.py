import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import parsing, scoring
from sparkassay.operators import results


@pytest.mark.parametrize("raw,sql,why", [
    ("SELECT 1", "SELECT 1", None),
    ("```sql\nSELECT 1\n```", "SELECT 1", None),
    ("Reasoning:\n a b \n\nSQL:\n```\nSELECT 2;\n```", "SELECT 2;", "a b"),
    ("sql: SELECT 1\nSQL: SELECT 2", "SELECT 1\nSQL: SELECT 2", None),
    ("note SQL: SELECT 1", "note SQL: SELECT 1", None),
    ("Reasoning:\n\nSQL:", "", ""),
    ("REASONING: \n x\nSQL:y", "y", "x"),
    ("", "", None),
])
def test_marker_rules(spark, raw, sql, why):
    row = spark.createDataFrame([(raw,)], "r string").select(
        parsing.extract_sql("r").alias("s"), parsing.extract_reasoning("r").alias("w")).first()
    assert (row.s, row.w) == (sql, why)


@pytest.mark.parametrize("raw,cot,sql,why", [
    ('{"sql": " A "}', False, "A", None), ('{"sql": "A", "reasoning": "r"}', True, "A", "r"), ('{"x": 1}', True, "", None),
    ('{"sql": null}', False, '{"sql": null}', None), ('{"sql": 3}', False, '{"sql": 3}', None), ('["SQL"]', False, '["SQL"]', None),
    ('{"sql": "A"', False, '{"sql": "A"', None), ("SQL: B", True, "B", None), ("", False, "", None),
])
def test_json_completions(spark, raw, cot, sql, why):
    row = spark.createDataFrame([(raw, cot)], "r string, c boolean").select(
        parsing.parse_completion(F.col("r"), F.col("c")).alias("p")).first().p
    assert (row.sql, row.reasoning) == (sql, why)


def test_json_mode_names(spark):
    rows = [("openai/gpt-4o-mini", False, True), ("x/llama", False, False), ("x/llama", True, True), ("O3-mini", False, True)]
    df = spark.createDataFrame(rows, "m string, v boolean, w boolean")
    assert df.filter(parsing.json_mode(F.col("m"), F.col("v")) != F.col("w")).count() == 0


def test_normalised_cells(spark):
    df = spark.createDataFrame([(1, 10, 2.675, Decimal("1.005"), " x ", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), None, True)],
                               "q int, a int, b double, c decimal(10,3), d string, e date, f timestamp, g string, h boolean")
    cells = results.normalize_rows(df, ["q"], list("abcdefgh")).first().cells
    assert cells == ["n:10.00", "n:2.68", "n:1.00", "s:x", "s:2024-01-02", "s:2024-01-02T03:04:05", None, "b:true"]


def long(spark, data):
    rows = [(q, n, cells) for q, result in data.items() for n, cells in enumerate(result)]
    return spark.createDataFrame(rows, "qid int, row_no int, cells array<string>").repartition(3)


def test_match_scores(spark):
    a, b, c = ["n:1.00", "s:a"], ["n:2.00", "s:b"], ["n:3.00", None]
    expected = {1: [a, b], 2: [a, a, b], 3: [a, b], 4: [a], 5: [a, b], 7: [a], 8: [c, a], 9: [a]}
    actual = {1: [b, a], 2: [a, b, b], 3: [a], 4: [["n:1.00"]], 5: [a, b], 7: [a], 8: [a, c], 9: [a], 10: [a]}
    runs = spark.createDataFrame(
        [(q, "" if q == 9 else "S", "boom" if q == 7 else None) for q in range(1, 12)], "qid int, sql string, error string")
    got = {r.qid: r.value for r in results.result_match(runs, long(spark, actual), long(spark, expected), "qid").collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 1.0, 6: 1.0, 7: 0.0, 8: 1.0, 9: 0.0, 10: 0.0, 11: 1.0}
    strict = {r.qid: r.value for r in results.strict_match(runs, long(spark, actual), long(spark, expected), "qid").collect()}
    assert strict == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0, 8: 0, 9: 0, 10: 0, 11: 1}
    ok = {r.qid: r.value for r in results.execution_ok(runs, "qid").collect()}
    assert [q for q, v in ok.items() if v == 0] == [7, 9]


def test_one_question_with_most_rows(spark):
    big = spark.range(20000).select(F.lit(1).alias("qid"), F.col("id").cast("int").alias("row_no"),
                                    F.array(F.concat(F.lit("n:"), (F.col("id") % 100).cast("string"))).alias("cells"))
    got = results.compare_rows(big, big.filter("row_no <> 17"), "qid").first()
    assert (got.equal, got.n_actual, got.n_expected) == (False, 20000, 19999)
    assert results.compare_rows(big, big.orderBy(F.desc("row_no")), "qid").first().equal


def test_recall_defaults(spark):
    df = spark.createDataFrame([("", ["a("]), ("SELECT 1", ["a(x)"]), ("SELECT * FROM a, b", []), ("SELECT * FROM a, b", ["xA(q)", "c("]),
                                ("SELECT * FROM a", None)], "s string, r array<string>")
    got = [r[0] for r in df.select(scoring.table_recall_substring(F.col("s"), F.col("r"))).collect()]
    assert got == [0.0, 1.0, 1.0, 0.5, 1.0]


def test_keyword_quality(spark):
    rows = [("Free returns", ["free", "return"], "partial", True, 0.5), ("free", ["free", "return"], None, False, 0.5),
            ("nope", ["free"], "correct", True, 0.0), ("", ["free"], "correct", True, 0.0), ("free", ["free"], "odd", True, 0.0)]
    df = spark.createDataFrame(rows, "a string, k array<string>, v string, j boolean, w double")
    assert df.filter(scoring.keyword_quality(F.col("a"), F.col("k"), F.col("v"), F.col("j")) != F.col("w")).count() == 0


def test_data_present(spark):
    df = spark.createDataFrame([("a 1", True), ("٣", True), ("none", False), (None, False)], "a string, w boolean")
    assert df.filter(scoring.data_present(F.col("a")) != F.col("w")).count() == 0
