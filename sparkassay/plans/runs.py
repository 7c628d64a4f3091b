"""Run-log analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import parsing, scoring
from sparkassay.operators import chunking, runlog
from sparkassay.operators.features import hash_embed
from sparkassay.operators.relational import attach
from sparkassay.plans.fixtures import ATTEMPTS, CATALOG, CATALOG_QUESTIONS, JOBS, RUN_SCORES, STREAM, TOOL_CALLS
from sparkassay.plans.registry import plain, query
from sparkassay.plans.retrieval import CI, CQ, O_CHUNKS, o_dense, o_sparse, passages, P
from sparkassay.plans.scoring import O_LONG, RS, SCORERS
from sparkassay.plans.text import DOCS, o_fixed, o_packed
from sparkassay.plans.retrieval import link
from sparkassay.operators.vector_index import VectorIndex
from sparkassay.session import materialize, scratch_path
from sparkassay.sources.catalog import table_name

A, TC, J, SE = plain(ATTEMPTS), plain(TOOL_CALLS), plain(JOBS), plain(STREAM)


@query("fold_attempts", f"""
WITH c AS (SELECT *, min(CASE WHEN error IS NULL THEN attempt END) OVER (PARTITION BY qid) AS ok FROM ({A}) WHERE attempt <= 3),
k AS (SELECT * FROM c WHERE ok IS NULL OR attempt <= ok)
SELECT qid, arg_max(sql, attempt) AS sql, last(error ORDER BY attempt) AS error, max(attempt) AS attempts,
  CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(cost) AS DOUBLE) AS cost FROM k GROUP BY qid""")
def q_fold_attempts(wh):
    return runlog.fold_attempts(wh.sql(ATTEMPTS), "qid").withColumn("cost", F.col("cost").cast("double"))


@query("tool_trace", f"""
SELECT qid, count(*) AS n_calls, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, arg_max(s, (iteration, call)) FILTER (WHERE s IS NOT NULL) AS last_sql,
  max(iteration) AS iterations, CASE WHEN max(iteration) >= 4 THEN 'no final answer' END AS note
FROM (SELECT *, CASE WHEN tool = 'query_database' AND j IS NOT NULL THEN coalesce(j->>'$.sql', '') END AS s
      FROM (SELECT *, TRY_CAST(arguments AS JSON) AS j FROM ({TC}))) GROUP BY qid""")
def q_tool_trace(wh):
    calls = wh.sql(TOOL_CALLS).withColumn("args", parsing.parse_tool_args(F.col("tool"), F.col("arguments")))
    return runlog.tool_trace(calls, "qid", F.col("args.value"), max_rounds=4)


@query("tool_log", f"SELECT qid, iteration, call, tool, substr(result, 1, 500) AS result FROM ({TC})")
def q_tool_log(wh):
    return runlog.cut_results(wh.sql(TOOL_CALLS)).select("qid", "iteration", "call", "tool", "result")


@query("fold_events", f"""
WITH e AS (SELECT *, count(*) FILTER (WHERE kind = 'retry') OVER (PARTITION BY request_id ORDER BY ts, event_id) AS seg FROM ({SE})),
l AS (SELECT request_id, max(seg) AS retries, min(ts) AS a, max(ts) AS b,
  arg_max(kind, (ts, event_id)) FILTER (WHERE kind IN ('done', 'error')) AS status FROM e GROUP BY request_id)
SELECT l.request_id, coalesce(string_agg(content, '' ORDER BY ts, event_id) FILTER (WHERE kind = 'sql_token' AND seg = retries), '') AS sql_text,
  retries, status, round((epoch_us(b) - epoch_us(a)) / 1e6, 3) AS latency
FROM l JOIN e USING (request_id) GROUP BY l.request_id, retries, status, a, b""")
def q_fold_events(wh):
    return runlog.fold_events(wh.sql(STREAM), "request_id", "ts", "event_id")


O_BOARD = f"""SELECT strategy, count(*) AS total_jobs,
  CASE WHEN bool_or(status IN ('pending', 'running')) THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed'
    WHEN bool_or(status = 'completed') THEN 'done' ELSE 'pending' END AS status,
  {', '.join(f"round(avg(CASE WHEN status = 'completed' THEN {m} END), 4)::DOUBLE AS {m}" for m in runlog.JOB_METRICS)}
FROM ({J}) GROUP BY strategy"""


def board(wh):
    b = runlog.leaderboard(wh.sql(JOBS))
    return b.select("strategy", "total_jobs", "status", *[F.round(m, 4).alias(m) for m in runlog.JOB_METRICS])


@query("leaderboard", O_BOARD)
def q_leaderboard(wh):
    return board(wh)


@query("status_rollup", f"""
SELECT batch, strategy, count(*) AS n, CASE WHEN bool_or(status IN ('pending', 'running')) THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed'
    WHEN bool_or(status = 'completed') THEN 'done' ELSE 'pending' END AS status FROM ({J}) GROUP BY ALL""")
def q_status_rollup(wh):
    return wh.sql(JOBS).groupBy("batch", "strategy").agg(F.count("*").alias("n"), runlog.status_rollup().alias("status"))


@query("sort_nulls_last", f"SELECT strategy, retrieval_recall FROM ({O_BOARD}) ORDER BY retrieval_recall DESC NULLS LAST, strategy")
def q_sort_nulls_last(wh):
    return runlog.sort_nulls_last(board(wh).select("strategy", "retrieval_recall"), "retrieval_recall", True, "strategy")


MODELS = "CASE WHEN run_id % 2 = 0 THEN 'gemini/flash' ELSE 'openai/gpt-4o-mini' END"


@query("strategy_summary", f"""
SELECT model, strategy, {', '.join(f"coalesce(CAST(CAST(round_even(avg(value) FILTER (WHERE scorer = '{s}'), 3) AS DECIMAL(18,3)) AS VARCHAR), '-') AS {s}" for s in [*SCORERS, 'retrieval_recall'])}
FROM (SELECT replace({MODELS}, 'gemini/', 'google/') AS model, strategy, scorer, value FROM ({O_LONG})) GROUP BY ALL""")
def q_strategy_summary(wh):
    rows = wh.sql(RUN_SCORES).withColumn("model", runlog.model_alias(F.expr(MODELS)))
    long = scoring.long_scores(rows, ["model", "strategy"], SCORERS)
    return runlog.strategy_summary(long, ["model", "strategy"], [*SCORERS, "retrieval_recall"])


O_GATE = f"""SELECT run_id, t.scorer, actual, threshold, coalesce(actual >= threshold, false) AS passed
FROM (SELECT DISTINCT run_id FROM ({RS})) CROSS JOIN (VALUES {', '.join(f"('{s}', {t}::DOUBLE)" for s, t in runlog.THRESHOLDS.items())}) t(scorer, threshold)
LEFT JOIN (SELECT run_id, scorer, round_even(avg(value), 4) AS actual FROM ({O_LONG}) GROUP BY ALL) USING (run_id, scorer)"""


def gated(wh):
    long = scoring.long_scores(wh.sql(RUN_SCORES), ["run_id"], SCORERS)
    return runlog.gate(long, "run_id")


@query("gate", O_GATE)
def q_gate(wh):
    return gated(wh)


@query("gate_verdict", f"""
SELECT run_id, bool_and(passed) AS passed, coalesce(string_agg(scorer, ',' ORDER BY scorer) FILTER (WHERE NOT passed), '') AS failures
FROM ({O_GATE}) GROUP BY run_id""")
def q_gate_verdict(wh):
    return runlog.gate_verdict(gated(wh), "run_id")


# ---- sweep over chunkers and cut-offs: a passage counts as found when it is in a retrieved chunk as a whole ----
KS = [3, 5]


def sweep_hits(wh, chunker: str):
    docs = wh.spread("documents").select("doc_id", "text")
    options = {"sentence": {"max_size": 400, "overlap": 1}, "fixed": {"size": 400, "overlap": 60}}[chunker]
    chunks = chunking.CHUNKERS[chunker](docs, **options).select(F.concat_ws(":", "doc_id", "chunk_index").alias("chunk_id"), "text")
    # Chunks are cut and hashed once, for the search and for their texts.
    index = VectorIndex(wh.spark, scratch_path(wh.spark, "chunks"), "chunk_id")
    index.add(hash_embed(chunks))
    hits = index.query(hash_embed(passages(wh)), "qid", max(KS), q_out="qid", i_out="chunk_id")
    return attach(hits, index.rows().select("chunk_id", "text"), "chunk_id").select("qid", "rank", "text")


O_SWEEP = f"""sw AS (SELECT 'sentence' AS chunker, qid, rank, text FROM (WITH RECURSIVE {o_packed(DOCS, 400, 1)},
    {o_dense(P, O_CHUNKS, 5, 'qid', 'chunk_id')}
    SELECT dense.*, c.text FROM dense JOIN ({O_CHUNKS}) c USING (chunk_id))
  UNION ALL SELECT 'fixed', qid, rank, text FROM (WITH fx AS (SELECT CAST(doc_id AS STRING) || ':' || CAST(chunk_index AS STRING) AS chunk_id, text FROM ({o_fixed(DOCS, 400, 60)})),
    {o_dense(P, 'SELECT chunk_id, text FROM fx', 5, 'qid', 'chunk_id')}
    SELECT dense.*, fx.text FROM dense JOIN fx USING (chunk_id)))"""


@query("config_sweep", f"""
WITH {O_SWEEP}, pq AS (SELECT c.chunker, k, q.qid, max(CASE WHEN rank <= k AND contains(lower(sw.text), lower(q.text)) THEN 1.0 ELSE 0.0 END) AS r
  FROM ({P}) q CROSS JOIN (VALUES (3), (5)) t(k) CROSS JOIN (VALUES ('sentence'), ('fixed')) c(chunker)
  LEFT JOIN sw ON sw.qid = q.qid AND sw.chunker = c.chunker GROUP BY ALL)
SELECT chunker, k AS top_k, count(*) AS n_questions, round(avg(r), 6)::DOUBLE AS recall FROM pq GROUP BY ALL""")
def q_config_sweep(wh):
    asked = passages(wh).select("qid", F.lower("text").alias("phrase"), F.explode(F.array(F.lit("sentence"), F.lit("fixed"))).alias("chunker"))
    hits = sweep_hits(wh, "sentence").withColumn("chunker", F.lit("sentence")).unionByName(
        sweep_hits(wh, "fixed").withColumn("chunker", F.lit("fixed")))
    hit = F.lower("text").contains(F.col("phrase"))
    per_question = asked.join(hits, ["chunker", "qid"], "left").groupBy("chunker", "qid").agg(*[
        F.max(F.when(hit & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(str(k)) for k in KS])
    long = per_question.unpivot(["chunker", "qid"], [str(k) for k in KS], "top_k", "r")
    return long.groupBy("chunker", F.col("top_k").cast("int").alias("top_k")).agg(
        F.count("*").alias("n_questions"), F.round(F.avg("r"), 6).alias("recall"))


# ---- schema-retrieval sweep: strategies x cut-offs over the derived catalogue ----
SWEEP_K = [1, 3, 5]
O_SCHEMA = f"""{o_dense(CQ, CI, 5, 'qid', 'pos')}, {o_sparse(CQ, CI, 5, 'qid', 'pos')},
lists AS (SELECT 'dense' AS strategy, qid, rank, pos FROM dense UNION ALL SELECT 'sparse', qid, rank, pos FROM sparse),
named AS (SELECT strategy, qid, rank, trim(split_part(text, '(', 1)) AS name FROM lists JOIN ({CI}) USING (pos)),
pq AS (SELECT s.strategy, k AS top_k, g.qid, max(CASE WHEN rank <= k AND name = required THEN 1.0::DOUBLE ELSE 0.0 END) AS recall
  FROM ({plain(CATALOG_QUESTIONS)}) g CROSS JOIN (VALUES (1), (3), (5)) t(k) CROSS JOIN (VALUES ('dense'), ('sparse')) s(strategy)
  LEFT JOIN named ON named.qid = g.qid AND named.strategy = s.strategy GROUP BY ALL),
cfg AS (SELECT strategy, top_k, CAST((CASE strategy WHEN 'dense' THEN 100 ELSE 200 END) + top_k AS INT) AS config, round(avg(recall), 6) AS recall,
  round(avg(CASE WHEN recall = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS perfect_recall,
  (CASE strategy WHEN 'dense' THEN 0.02 ELSE 0.03 END + top_k / 1000.0)::DOUBLE AS avg_query_time,
  (CASE strategy WHEN 'dense' THEN 0.0 ELSE (SELECT count(*) FROM part) * 15 / 1000.0 * 0.00002 END)::DOUBLE AS cost FROM pq GROUP BY ALL)"""


def schema_lists(wh):
    parts = [link(wh, how).withColumn("strategy", F.lit(how)) for how in ("dense", "sparse")]
    hits = attach(parts[0].unionByName(parts[1]), wh.sql(CATALOG), "pos")
    return hits.select("strategy", "qid", "rank", table_name("table_def").alias("name"))


def schema_questions(wh):
    """Recall of every (strategy, cut-off, question), from one ranked list per strategy; a question without hits counts as 0."""
    needed = wh.sql(CATALOG_QUESTIONS).select("qid", "required", F.explode(F.array(F.lit("dense"), F.lit("sparse"))).alias("strategy"))
    found = needed.join(schema_lists(wh), ["strategy", "qid"], "left")
    hit = F.col("name") == F.col("required")
    wide = found.groupBy("strategy", "qid").agg(*[
        F.max(F.when(hit & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(str(k)) for k in SWEEP_K])
    long = wide.unpivot(["strategy", "qid"], [str(k) for k in SWEEP_K], "top_k", "recall")
    code = F.when(F.col("strategy") == "dense", 100).otherwise(200) + F.col("top_k").cast("int")
    return long.withColumn("top_k", F.col("top_k").cast("int")).withColumn("config", code)


def schema_configs(wh, per_question=None):
    dense = F.col("strategy") == "dense"
    table = (per_question or schema_questions(wh)).groupBy("strategy", "top_k", "config").agg(
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg((F.col("recall") == 1).cast("double")), 6).alias("perfect_recall"))
    n_tables = wh.part.agg(F.count("*")).scalar()
    return (table.withColumn("avg_query_time", F.round(F.when(dense, 0.02).otherwise(0.03) + F.col("top_k") / 1000.0, 6))
            .withColumn("cost", F.when(dense, F.lit(0.0)).otherwise(
                runlog.cost_estimate(n_tables, F.lit(0), F.lit(0.00002)))))


@query("schema_sweep", f"""
WITH {O_SCHEMA} SELECT config, strategy, top_k, recall, perfect_recall, round(avg_query_time, 6) AS avg_query_time, round(cost, 9) AS cost FROM cfg""")
def q_schema_sweep(wh):
    return schema_configs(wh).withColumn("cost", F.round("cost", 9))


@query("rank_configs", f"""
WITH {O_SCHEMA} SELECT arg_max(config, (recall, perfect_recall, -avg_query_time, -config)) AS best_overall, arg_max(config, (-avg_query_time, -config)) AS fastest,
  arg_max(config, (recall, -config)) FILTER (WHERE cost = 0 AND strategy <> 'sparse') AS best_free FROM cfg""")
def q_rank_configs(wh):
    return runlog.takeaways(schema_configs(wh))


@query("ranked_configs", f"""
WITH {O_SCHEMA} SELECT config, recall, perfect_recall FROM cfg ORDER BY recall DESC, perfect_recall DESC, avg_query_time, config""")
def q_ranked_configs(wh):
    return runlog.rank_configs(schema_configs(wh)).select("config", "recall", "perfect_recall")


@query("best_by_strategy_k", f"""
WITH {O_SCHEMA} SELECT strategy, {', '.join(f'max(recall) FILTER (WHERE top_k = {k}) AS "{k}"' for k in SWEEP_K)} FROM cfg GROUP BY strategy""")
def q_best_by_strategy_k(wh):
    return runlog.best_by_strategy_k(schema_configs(wh), SWEEP_K)


@query("question_breakdown", f"""
WITH {O_SCHEMA}, b AS (SELECT arg_max(config, (recall, perfect_recall, -avg_query_time, -config)) AS config FROM cfg)
SELECT b.config, qid, CASE WHEN pq.recall = 1 THEN 'full' WHEN pq.recall > 0 THEN 'partial' ELSE 'none' END AS status
FROM b JOIN cfg USING (config) JOIN pq ON pq.strategy = cfg.strategy AND pq.top_k = cfg.top_k""")
def q_question_breakdown(wh):
    per_question = materialize(schema_questions(wh), "question-recall")
    best = runlog.takeaways(schema_configs(wh, per_question)).select(F.col("best_overall").alias("config"))
    return runlog.best_questions(per_question, best)


# Prices per 1k tokens of an embedding model chosen per brand.
@query("cost_estimate", """
SELECT p_brand, count(*) AS n_tables, round((count(*) * 15 + sum(p_size) * 20) / 1000.0::DOUBLE * (CASE WHEN p_brand LIKE '%1%' THEN 0.00013 ELSE 0.00002 END)::DOUBLE, 9)::DOUBLE AS cost
FROM part GROUP BY p_brand""")
def q_cost_estimate(wh):
    per_brand = wh.part.groupBy("p_brand").agg(F.count("*").alias("n_tables"), F.sum("p_size").alias("n_questions"))
    price = F.when(F.col("p_brand").contains("1"), F.lit(0.00013)).otherwise(F.lit(0.00002))
    return per_brand.select("p_brand", "n_tables", F.round(
        runlog.cost_estimate(F.col("n_tables"), F.col("n_questions"), price), 9).alias("cost"))


PARTS = "CASE qid % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'policy' ELSE 'hybrid' END"


@query("part_summary", f"""
SELECT {PARTS} AS part, strategy, count(*) AS n, round(avg(coalesce(result_match, 0)), 6) AS result_match,
  round(avg(coalesce(semantic_judge, 0)), 6)::DOUBLE AS semantic_judge FROM ({RS}) GROUP BY ALL""")
def q_part_summary(wh):
    rows = wh.sql(RUN_SCORES).withColumn("part", F.expr(PARTS))
    out = runlog.part_summary(rows, ["result_match", "semantic_judge"])
    return out.select("part", "strategy", "n", F.round("result_match", 6).alias("result_match"),
                      F.round("semantic_judge", 6).alias("semantic_judge"))


@query("token_cost_rollup", f"""
SELECT run_id, strategy, CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens,
  CAST(sum(cost) AS DOUBLE) AS cost, count(*) AS n_questions FROM ({RS}) GROUP BY ROLLUP (run_id, strategy)""")
def q_token_cost_rollup(wh):
    return runlog.token_cost_rollup(wh.sql(RUN_SCORES), "run_id", "strategy")


KEYS = ["batch", "strategy", "difficulty"]


@query("pending_runs", f"""
SELECT batch, s.strategy, d.difficulty FROM (SELECT DISTINCT batch FROM ({J})) CROSS JOIN (SELECT DISTINCT strategy FROM ({J})) s
CROSS JOIN (SELECT DISTINCT difficulty FROM ({J})) d
EXCEPT SELECT batch, strategy, difficulty FROM ({J}) WHERE status = 'completed'""")
def q_pending_runs(wh):
    jobs = wh.sql(JOBS)
    strategies = ["zero_shot", "few_shot_static", "few_shot_dynamic", "rag_hybrid", "tool_use"]
    combos = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(d).alias("difficulty"))
                       for s in strategies for d in ("easy", "medium", "hard")])
    requested = jobs.select("batch").distinct().select("batch", F.inline(combos))
    return runlog.pending_runs(requested, jobs, KEYS)


@query("finished_runs", f"SELECT job_id, strategy, status FROM ({J}) WHERE status IN ('completed', 'failed')")
def q_finished_runs(wh):
    return runlog.finished_runs(wh.sql(JOBS)).select("job_id", "strategy", "status")
