"""Result comparison, recall and scorecard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import parsing, scoring
from sparkassay.operators import results, retrieval
from sparkassay.operators.relational import attach
from sparkassay.plans.fixtures import (ACTUAL_ROWS, CATALOG, CATALOG_QUESTIONS, EXECUTIONS, EXPECTED_ROWS, PASSAGES,
                                       RUN_SCORES, VERDICTS)
from sparkassay.plans.registry import plain, query
from sparkassay.plans.retrieval import CI, CQ, IDS, P, docs, linked, o_bm25, o_dense, passages
from sparkassay.plans.text import DOCS
from sparkassay.sources.catalog import table_name

COLUMNS = ["part", "quantity", "price", "flag", "shipped"]


def o_cells(src: str) -> str:
    num = lambda c: f"'n:' || CAST(CAST(round_even(CAST({c} AS DECIMAL(18,4)), 2) AS DECIMAL(38,2)) AS VARCHAR)"
    return f"""SELECT qid, row_no, [{num('part')}, {num('quantity')}, {num('price')}, 's:' || trim(flag),
      's:' || strftime(shipped, '%Y-%m-%dT%H:%M:%S')] AS cells FROM ({plain(src)})"""


O_A, O_E = o_cells(ACTUAL_ROWS), o_cells(EXPECTED_ROWS)
X = plain(EXECUTIONS)


def actual(wh):
    return results.normalize_rows(wh.sql(ACTUAL_ROWS, spread=True), ["qid", "row_no"], COLUMNS)


def expected(wh):
    return results.normalize_rows(wh.sql(EXPECTED_ROWS, spread=True), ["qid", "row_no"], COLUMNS)


@query("normalize_rows", f"SELECT qid, row_no, array_to_string(cells, '|') AS cells FROM ({O_A})")
def q_normalize_rows(wh):
    return actual(wh).withColumn("cells", F.array_join("cells", "|", "null"))


O_MULTI = f"""ca AS (SELECT qid, cells, count(*) AS n FROM ({O_A}) GROUP BY ALL), ce AS (SELECT qid, cells, count(*) AS n FROM ({O_E}) GROUP BY ALL),
eq AS (SELECT coalesce(ca.qid, ce.qid) AS qid, bool_and(coalesce(ca.n, 0) = coalesce(ce.n, 0)) AS equal
       FROM ca FULL JOIN ce ON ca.qid = ce.qid AND ca.cells = ce.cells GROUP BY ALL),
na AS (SELECT qid, count(*) AS n_actual FROM ({O_A}) GROUP BY qid), ne AS (SELECT qid, count(*) AS n_expected FROM ({O_E}) GROUP BY qid)"""


@query("rows_equal", f"""
WITH {O_MULTI} SELECT qid, equal, coalesce(n_actual, 0) AS n_actual, coalesce(n_expected, 0) AS n_expected
FROM eq LEFT JOIN na USING (qid) LEFT JOIN ne USING (qid)""")
def q_rows_equal(wh):
    return results.compare_rows(actual(wh), expected(wh), "qid").select("qid", "equal", "n_actual", "n_expected")


@query("result_match", f"""
WITH {O_MULTI} SELECT x.qid, CAST(CASE WHEN sql = '' OR error IS NOT NULL THEN 0 WHEN coalesce(equal, true) THEN 1
  WHEN n_actual = n_expected AND n_actual > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS value
FROM ({X}) x LEFT JOIN eq USING (qid) LEFT JOIN na USING (qid) LEFT JOIN ne USING (qid)""")
def q_result_match(wh):
    return results.result_match(wh.sql(EXECUTIONS), actual(wh), expected(wh), "qid")


O_SEQ = f"""sa AS (SELECT qid, list((row_no, cells) ORDER BY row_no, cells) AS l FROM ({O_A}) GROUP BY qid),
se AS (SELECT qid, list((row_no, cells) ORDER BY row_no, cells) AS l FROM ({O_E}) GROUP BY qid)"""


@query("strict_match", f"""
WITH {O_SEQ} SELECT x.qid, CASE WHEN sql <> '' AND error IS NULL AND sa.l IS NOT DISTINCT FROM se.l THEN 1 ELSE 0 END AS value
FROM ({X}) x LEFT JOIN sa USING (qid) LEFT JOIN se USING (qid)""")
def q_strict_match(wh):
    return results.strict_match(wh.sql(EXECUTIONS), actual(wh), expected(wh), "qid")


@query("execution_ok", f"SELECT qid, CASE WHEN sql = '' OR error IS NOT NULL THEN 0 ELSE 1 END AS value FROM ({X})")
def q_execution_ok(wh):
    return results.execution_ok(wh.sql(EXECUTIONS), "qid")


# Long result sets for the previews: all orders of a customer.
HISTORY = """SELECT o_custkey AS qid, o_orderkey AS row_no, o_orderkey AS part, o_totalprice AS price,
  o_orderstatus AS flag FROM {orders}"""
HISTORY_RUNS = """SELECT c_custkey AS qid, 'History of ' || c_name AS question,
  CASE WHEN c_custkey % 37 = 0 THEN '' ELSE 'SELECT * FROM orders WHERE o_custkey = ' || CAST(c_custkey AS STRING) END AS sql,
  CASE WHEN c_custkey % 41 = 0 THEN 'timeout' END AS error FROM {customer}"""
O_H = f"""SELECT qid, row_no, ['n:' || CAST(CAST(part AS DECIMAL(38,2)) AS VARCHAR),
  'n:' || CAST(CAST(round_even(CAST(price AS DECIMAL(18,4)), 2) AS DECIMAL(38,2)) AS VARCHAR), 's:' || flag] AS cells FROM ({plain(HISTORY)})"""


def history(wh):
    return results.normalize_rows(wh.sql(HISTORY), ["qid", "row_no"], ["part", "price", "flag"])


def o_preview(k: int, cell_sql: str, sep: str) -> str:
    return f"""SELECT qid, max(c) AS row_count, string_agg({cell_sql}, '{sep}' ORDER BY row_no) FILTER (WHERE n <= {k}) AS shown
      FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS c, row_number() OVER (PARTITION BY qid ORDER BY row_no) AS n FROM ({O_H})) GROUP BY qid"""


O_JSON_ROW = """'["' || array_to_string(cells, '","') || '"]'"""


@query("result_preview", f"""
SELECT x.qid, CASE WHEN error IS NOT NULL THEN 'SQL ERROR: ' || error WHEN row_count IS NULL THEN 'Query executed successfully. No rows returned.'
  ELSE '{{"row_count":' || row_count || ',"truncated":' || CASE WHEN row_count > 12 THEN 'true' ELSE 'false' END || ',"rows":[' || shown || ']}}' END AS result
FROM ({plain(HISTORY_RUNS)}) x LEFT JOIN ({o_preview(12, O_JSON_ROW, ',')}) USING (qid)""")
def q_result_preview(wh):
    return results.result_preview(wh.sql(HISTORY_RUNS), history(wh), "qid", 12)


O_PAREN_ROW = "'(' || array_to_string(cells, ', ') || ')'"


@query("judge_prompt", f"""
WITH p AS ({o_preview(10, O_PAREN_ROW, ', ')}),
s AS (SELECT qid, '[' || shown || ']' || CASE WHEN row_count > 10 THEN '  ... (' || row_count || ' rows total)' ELSE '' END AS t FROM p)
SELECT x.qid, 'Question: ' || question || chr(10) || chr(10) || 'SQL:' || chr(10) || sql || chr(10) || chr(10) || 'Result:' || chr(10)
  || CASE WHEN error IS NOT NULL THEN 'ERROR: ' || error ELSE coalesce(t, '[]') END
  || chr(10) || chr(10) || 'Expected:' || chr(10) || coalesce(t, '[]') AS prompt
FROM ({plain(HISTORY_RUNS)}) x LEFT JOIN s USING (qid) WHERE sql <> ''""")
def q_judge_prompt(wh):
    rows = history(wh)
    return results.judge_prompt(wh.sql(HISTORY_RUNS), rows, rows, "qid")


@query("judge_score", f"""
SELECT x.qid, coalesce(CASE WHEN x.sql = '' THEN 0.0 WHEN v.r IS NULL THEN 0.0 WHEN v.v = 'correct' THEN 1.0 WHEN v.v = 'partial' THEN 0.5 END, 0.0)::DOUBLE AS value
FROM ({X}) x LEFT JOIN (SELECT cid, j->>'$.verdict' AS v, j->>'$.reasoning' AS r
  FROM (SELECT cid, TRY_CAST(raw AS JSON) AS j FROM ({plain(VERDICTS)}))) v ON v.cid = x.qid""")
def q_judge_score(wh):
    replies = wh.sql(VERDICTS).select("cid", "raw")
    joined = wh.sql(EXECUTIONS).join(replies, F.col("cid") == F.col("qid"), "left")
    return joined.select("qid", parsing.parse_verdict(F.col("raw"), F.col("sql"))["value"].alias("value"))


GOLDEN = """SELECT qid, required, CASE WHEN qid % 10 = 0 THEN '' WHEN qid % 10 = 1 THEN 'SELECT 1'
  ELSE 'SELECT a.price FROM ' || required || ' a JOIN region b ON a.id = b.r_regionkey' END AS sql FROM (""" + CATALOG_QUESTIONS + ")"
G = plain(GOLDEN)
O_HITS = f"""{o_dense(CQ, CI, 5, 'qid', 'pos')},
hits AS (SELECT qid, list(lower(text)) AS defs, list(trim(split_part(text, '(', 1))) AS names FROM dense JOIN ({CI}) USING (pos) GROUP BY qid)"""


def hit_lists(wh):
    """Retrieved definitions and names per question."""
    return linked(wh, "dense").groupBy("qid").agg(F.collect_list("table_def").alias("defs"),
                                   F.collect_list(table_name("table_def")).alias("names"))


@query("table_recall_substring", f"""
WITH {O_HITS}, req AS (SELECT qid, sql = '' AS blank, CASE WHEN qid % 10 < 2 THEN []::VARCHAR[] ELSE [lower(required), 'region'] END AS req FROM ({G}))
SELECT qid, CASE WHEN blank THEN 0.0 WHEN defs IS NULL THEN 1.0 WHEN len(req) = 0 THEN 1.0 ELSE
  len(list_filter(req, lambda t: len(list_filter(defs, lambda d: contains(d, t || '('))) > 0))::DOUBLE / len(req) END AS value
FROM req LEFT JOIN hits USING (qid)""")
def q_table_recall_substring(wh):
    joined = wh.sql(GOLDEN).join(hit_lists(wh), "qid", "left")
    return joined.select("qid", scoring.table_recall_substring(F.col("sql"), F.col("defs")).alias("value"))


@query("recall_at_k", f"""
WITH {O_HITS}, r AS (SELECT qid, CASE WHEN qid % 10 = 1 THEN []::VARCHAR[] ELSE [required, 'region'] END AS req FROM ({G}))
SELECT count(*) AS n_questions, round(avg(v), 6) AS recall, round(avg(CASE WHEN v = 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS perfect_recall
FROM (SELECT qid, CASE WHEN len(req) = 0 THEN 1.0 ELSE len(list_filter(req, lambda t: list_contains(coalesce(names, []), t)))::DOUBLE / len(req) END AS v
      FROM r LEFT JOIN hits USING (qid))""")
def q_recall_at_k(wh):
    required = F.when(F.col("qid") % 10 == 1, F.array().cast("array<string>")).otherwise(F.array("required", F.lit("region")))
    joined = wh.sql(GOLDEN).join(hit_lists(wh), "qid", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return joined.select(scoring.recall_at_k(names, required).alias("v")).agg(
        F.count("*").alias("n_questions"), F.round(F.avg("v"), 6).alias("recall"),
        F.round(F.avg((F.col("v") == 1).cast("double")), 6).alias("perfect_recall"))


PHRASES = """SELECT qid, text AS p1, 'no such phrase ' || CAST(qid AS STRING) AS p2 FROM (""" + PASSAGES + ")"


@query("phrase_recall", f"""
WITH {o_bm25(P, DOCS, 3, 'qid', 'doc_id')},
t AS (SELECT qid, lower(string_agg(text, ' ' ORDER BY rank)) AS body FROM bm25 JOIN documents USING (doc_id) GROUP BY qid)
SELECT qid, CASE WHEN contains(coalesce(body, ''), lower(p1)) OR contains(coalesce(body, ''), lower(p2)) THEN 1.0 ELSE 0.0 END::DOUBLE AS value
FROM ({plain(PHRASES)}) LEFT JOIN t USING (qid)""")
def q_phrase_recall(wh):
    hits = retrieval.topk_bm25(passages(wh), docs(wh), 3, "qid", "doc_id", **IDS)
    texts = (attach(hits, wh.documents.select("doc_id", "text"), "doc_id").groupBy("qid")
             .agg(F.sort_array(F.collect_list(F.struct("rank", "text")))["text"].alias("texts")))
    joined = wh.sql(PHRASES).join(texts, "qid", "left")
    none = F.array().cast("array<string>")
    return joined.select("qid", scoring.phrase_recall(F.coalesce("texts", none), F.array("p1", "p2")).alias("value"))


# Answers: assistant turns; keywords and judge verdicts by conversation.
SCORED = """SELECT conv_id, turn, text AS answer, CASE conv_id % 4 WHEN 0 THEN 'SELECT 1' WHEN 1 THEN '' WHEN 2 THEN 'SELECT * FROM vault'
    ELSE 'SELECT * FROM orders JOIN part ON true' END AS golden_sql, array('orders(id)', 'region(id)') AS retrieved_defs,
  array('orders', role) AS retrieved, array('orders', 'user') AS required, array(text) AS texts, array('The ', ' und ') AS phrases
FROM {conversations}"""


@query("scores_by_name", """
SELECT conv_id, turn, unnest(['data_present', 'phrase_recall', 'recall_at_k', 'retrieval_recall']) AS scorer, unnest([
  CASE WHEN regexp_matches(text, '\\p{Nd}') THEN 1.0 ELSE 0.0 END, CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), ' und ') THEN 1.0 ELSE 0.0 END,
  CASE WHEN role = 'user' THEN 1.0 ELSE 0.5 END, CASE conv_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE 0.5 END]::DOUBLE[]) AS value
FROM conversations""")
def q_scores_by_name(wh):
    return scoring.score_by_name(wh.sql(SCORED), ["conv_id", "turn"], ["data_present", "phrase_recall", "recall_at_k", "retrieval_recall"])


ANSWERS = """SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS qid, CASE WHEN conv_id % 9 = 0 THEN '' ELSE text END AS answer,
  CASE conv_id % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'DE ' ELSE 'qqq' END AS k1, 'und' AS k2,
  CASE conv_id % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'incorrect' WHEN 3 THEN 'other' END AS verdict
FROM {conversations} WHERE role = 'assistant'"""


@query("keyword_quality", f"""
SELECT qid, h AS hits, CASE WHEN answer = '' OR h = 0 THEN 0.0 WHEN verdict IS NULL THEN least(h / 2.0, 1.0)
  WHEN verdict = 'correct' THEN 1.0 WHEN verdict = 'partial' THEN 0.5 ELSE 0.0 END::DOUBLE AS value
FROM (SELECT *, CAST(contains(lower(answer), lower(k1)) AS INT) + CAST(contains(lower(answer), k2) AS INT) AS h FROM ({plain(ANSWERS)}))""")
def q_keyword_quality(wh):
    keywords = F.array("k1", "k2")
    return wh.sql(ANSWERS).select(
        "qid", scoring.keyword_hits(F.col("answer"), keywords).alias("hits"),
        scoring.keyword_quality(F.col("answer"), keywords, F.col("verdict"), F.col("verdict").isNotNull()).alias("value"))


@query("data_present", """
SELECT conv_id, turn, regexp_matches(text, '\\p{Nd}') AS has_data FROM conversations WHERE role = 'assistant'""")
def q_data_present(wh):
    return (wh.conversations.filter(F.col("role") == "assistant")
            .select("conv_id", "turn", scoring.data_present(F.col("text")).alias("has_data")))


RS = plain(RUN_SCORES)


def o_mean(c: str) -> str:
    return f"round(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / count(*), 6)"


@query("run_means", f"""
SELECT run_id, strategy, {o_mean('coalesce(attempts, 1)')} AS avg_attempts, {o_mean('coalesce(cost, 0)')} AS avg_cost,
  {o_mean('coalesce(latency, 0)')} AS avg_latency, {o_mean('coalesce(prompt_tokens + completion_tokens, 0)')} AS avg_total_tokens,
  {o_mean('coalesce(n_tool_calls, 0)')} AS avg_tool_calls
FROM ({RS}) GROUP BY ALL""")
def q_run_means(wh):
    means = scoring.run_means(wh.sql(RUN_SCORES), ["run_id", "strategy"], F.col("n_tool_calls"))
    return means.select("run_id", "strategy", *[F.round(c, 6).alias(c) for c in means.columns[2:]])


@query("diagnostic_scores", f"""
SELECT run_id, round(sum(CASE WHEN qid % 4 = 0 THEN 1.0::DOUBLE ELSE f END) / count(*), 6) AS faithfulness, round(sum(q) / count(*), 6) AS quality
FROM (SELECT run_id, qid, coalesce(result_match, 0.5) AS f, coalesce(semantic_judge, 0.25)::DOUBLE AS q FROM ({RS})) GROUP BY run_id""")
def q_diagnostic_scores(wh):
    rows = wh.sql(RUN_SCORES).withColumn(
        "context", F.when(F.col("qid") % 4 != 0, F.array(F.lit("orders(id)"))))
    faithful = scoring.diagnostic_faithfulness(F.col("context"), F.coalesce("result_match", F.lit(0.5)))
    return rows.groupBy("run_id").agg(
        F.round(F.avg(faithful), 6).alias("faithfulness"),
        F.round(F.avg(F.coalesce("semantic_judge", F.lit(0.25))), 6).alias("quality"))


SCORERS = ["syntax_valid", "execution_ok", "result_match", "semantic_judge"]
O_LONG = " UNION ALL ".join(f"SELECT run_id, strategy, '{s}' AS scorer, CAST({s} AS DOUBLE) AS value FROM ({RS})" for s in SCORERS)


@query("scorecard", f"""
SELECT run_id, strategy, scorer, round(avg(value), 6) AS mean, count(*) AS total_samples FROM ({O_LONG}) GROUP BY ALL""")
def q_scorecard(wh):
    long = scoring.long_scores(wh.sql(RUN_SCORES), ["run_id", "strategy"], SCORERS)
    return scoring.scorecard(long, ["run_id", "strategy"]).withColumn("mean", F.round("mean", 6))


@query("score_maps", f"""
SELECT run_id, max(n) AS total_samples, '{{' || string_agg('"' || scorer || '":{{"accuracy":' || CAST(m AS DECIMAL(10,4)) || '}}', ',' ORDER BY scorer) || '}}' AS scores
FROM (SELECT run_id, scorer, count(*) AS n, round(avg(value), 4) AS m FROM ({O_LONG}) GROUP BY ALL) GROUP BY run_id""")
def q_score_maps(wh):
    long = scoring.long_scores(wh.sql(RUN_SCORES), ["run_id"], SCORERS)
    maps = scoring.score_maps(scoring.scorecard(long, ["run_id"]), ["run_id"])
    shown = F.transform_values("scores", lambda k, m: F.transform_values(m, lambda n, v: F.round(v, 4).cast("decimal(10,4)")))
    return maps.select("run_id", "total_samples", F.to_json(shown).alias("scores"))
