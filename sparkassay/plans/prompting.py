"""Prompt-table queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkassay.operators import prompts, selection, strategies
from sparkassay.operators.features import hash_embed
from sparkassay.operators.relational import attach
from sparkassay.operators.retrieval import STRATEGIES
from sparkassay.plans.fixtures import ATTEMPTS, CATALOG, CATALOG_QUESTIONS, QUESTIONS
from sparkassay.plans.registry import plain, query
from sparkassay.plans.retrieval import CI, CQ, O_LINK, o_rank
from sparkassay.plans.text import o_strip, o_vectors

Q, A = plain(QUESTIONS), plain(ATTEMPTS)
NL2 = "chr(10) || chr(10)"
HEAD = f"'{prompts.EXAMPLES_HEADER}' || {NL2}"
FOOT = f"{NL2} || '---' || chr(10)"

SCHEMA_ALL = "all tables"

# Example pool: user turns with a statement each.
POOL = """SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS ex_id, text, 'SELECT ' || CAST(turn AS STRING) || ' FROM t' AS sql
FROM {conversations} WHERE role = 'user'"""
O_PICKED = f"""pool AS ({plain(POOL)}), {o_vectors('SELECT ex_id, text FROM pool', 'ex_id', name='pv')},
{o_vectors('SELECT item_id AS qid, text FROM benchmark', 'qid', name='bv')},
dot AS (SELECT qid, ex_id, sum(bv.w * pv.w) AS s FROM bv JOIN pv USING (b) GROUP BY ALL),
near AS ({o_rank('''SELECT b.item_id AS qid, pool.ex_id, round(coalesce(s, 0), 6) AS score FROM benchmark b JOIN pool ON b.text <> pool.text
  LEFT JOIN dot ON dot.qid = b.item_id AND dot.ex_id = pool.ex_id''', 3, 'qid', 'ex_id')}),
blk AS (SELECT qid, {HEAD} || string_agg('Question: ' || text || chr(10) || 'SQL: ' || sql, {NL2} ORDER BY rank) || {FOOT} AS block
  FROM near JOIN pool USING (ex_id) GROUP BY qid)"""


def blocks(wh):
    pool = wh.sql(POOL)
    asked = wh.benchmark.select(F.col("item_id").alias("qid"), "text")
    hits = selection.fewshot_dynamic(hash_embed(asked), hash_embed(pool), "qid", "ex_id", q_out="qid", i_out="ex_id")
    chosen = attach(hits, pool, "ex_id")
    return prompts.ordered_pairs(chosen, "qid", "rank", "text").select("qid", prompts.fewshot_block(F.col("pairs")).alias("block"))


@query("fewshot_block", f"WITH {O_PICKED} SELECT * FROM blk")
def q_fewshot_block(wh):
    return blocks(wh)


ALL_STRATEGIES = f"element_at(array({', '.join(repr(s) for s in STRATEGIES)}), CAST(qid % {len(STRATEGIES)} AS INT) + 1)"
O_ALL = f"list_extract([{', '.join(repr(s) for s in STRATEGIES)}], CAST(qid % {len(STRATEGIES)} AS INT) + 1)"
O_TABLES = "'Database schema' || chr(10) || chr(10) || 'Tables:' || chr(10) || string_agg('  ' || text, chr(10) ORDER BY rank)"


O_DYNAMIC = "SELECT qid, text FROM asked WHERE strategy = 'few_shot_dynamic'"
O_NEAR = o_rank(f"""SELECT a.qid, pool.ex_id, round(coalesce(s, 0), 6) AS score FROM ({O_DYNAMIC}) a JOIN pool ON a.text <> pool.text
  LEFT JOIN (SELECT qid, ex_id, sum(av.w * pv.w) AS s FROM av JOIN pv USING (b) GROUP BY ALL) d ON d.qid = a.qid AND d.ex_id = pool.ex_id""",
                3, "qid", "ex_id")


@query("strategy_prompts", f"""
WITH {O_LINK}, asked AS (SELECT qid, text, {O_ALL} AS strategy FROM ({CQ})), pool AS ({plain(POOL)}),
{o_vectors('SELECT ex_id, text FROM pool', 'ex_id', name='pv')}, {o_vectors(O_DYNAMIC, 'qid', name='av')},
near AS ({O_NEAR}),
fixed AS (SELECT *, row_number() OVER (ORDER BY ex_id) AS rank FROM pool QUALIFY rank <= 3),
shown AS (SELECT qid, rank, text, sql FROM near JOIN pool USING (ex_id)
  UNION ALL SELECT qid, rank, fixed.text, sql FROM asked CROSS JOIN fixed WHERE strategy = 'few_shot_static'),
blk AS (SELECT qid, {HEAD} || string_agg('Question: ' || text || chr(10) || 'SQL: ' || sql, {NL2} ORDER BY rank) || {FOOT} AS block FROM shown GROUP BY qid),
lists AS (SELECT qid, rank, pos FROM dense JOIN asked USING (qid) WHERE strategy IN ('rag', 'rag_dense')
  UNION ALL SELECT qid, rank, pos FROM sparse JOIN asked USING (qid) WHERE strategy = 'rag_sparse'
  UNION ALL SELECT qid, rank, pos FROM fused JOIN asked USING (qid) WHERE strategy IN ('rag_hybrid', 'dspy')),
tabs AS (SELECT qid, {O_TABLES} AS defs FROM lists JOIN ({CI}) USING (pos) GROUP BY qid)
SELECT qid, strategy, CASE WHEN strategy = 'chain_of_thought' THEN '{prompts.SYSTEM_REASONED.replace("'", "''")}' ELSE '{prompts.SYSTEM_PLAIN}' END AS system,
  coalesce(block, '') || 'Schema:' || chr(10) || coalesce(defs, '{SCHEMA_ALL}') || {NL2} || 'Question: ' || text
  || CASE WHEN strategy = 'chain_of_thought' THEN '' ELSE {NL2} || 'SQL:' END AS user
FROM asked LEFT JOIN blk USING (qid) LEFT JOIN tabs USING (qid)""")
def q_strategy_prompts(wh):
    """All strategies in one table of questions."""
    asked = wh.sql(CATALOG_QUESTIONS).select("qid", F.col("question").alias("text"), F.expr(ALL_STRATEGIES).alias("strategy"))
    pool = wh.sql(POOL)
    static = pool.orderBy("ex_id").limit(3).withColumn("rank", F.row_number().over(Window.orderBy("ex_id")))
    definitions = wh.sql(CATALOG, spread=True).withColumnRenamed("table_def", "text")
    return strategies.prompts_by_strategy(asked, pool, static, definitions, SCHEMA_ALL)


STRATEGY = "CASE item_id % 3 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot_dynamic' ELSE 'chain_of_thought' END"
SCHEMA = "orders(o_orderkey, o_custkey)"


@query("render_prompt", f"""
WITH {O_PICKED} SELECT item_id AS qid, CASE WHEN {STRATEGY} = 'chain_of_thought' THEN '{prompts.SYSTEM_REASONED.replace("'", "''")}' ELSE '{prompts.SYSTEM_PLAIN}' END AS system,
  CASE WHEN {STRATEGY} = 'few_shot_dynamic' THEN block ELSE '' END || 'Schema:' || chr(10) || '{SCHEMA}' || {NL2} || 'Question: ' || text
  || CASE WHEN {STRATEGY} = 'chain_of_thought' THEN '' ELSE {NL2} || 'SQL:' END AS user
FROM benchmark LEFT JOIN blk ON qid = item_id""")
def q_render_prompt(wh):
    asked = wh.benchmark.withColumn("strategy", F.expr(STRATEGY))
    joined = asked.join(blocks(wh), F.col("qid") == F.col("item_id"), "left")
    block = F.when(F.col("strategy") == "few_shot_dynamic", F.col("block")).otherwise(F.lit(""))
    rendered = prompts.render_prompt(F.col("strategy"), block, F.lit(SCHEMA), F.col("text"))
    return joined.select(F.col("item_id").alias("qid"), rendered.alias("p")).select("qid", "p.*")


@query("prefix_stable_messages", f"""
SELECT qid, 'system>{prompts.SYSTEM_PLAIN}|user>Database schema:' || chr(10) || 'db_' || difficulty || '|assistant>{prompts.SCHEMA_NOTED}|user>Question: ' || question || {NL2} || 'SQL:' AS messages,
  sha256('system' || chr(31) || '{prompts.SYSTEM_PLAIN}' || chr(30) || 'user' || chr(31) || 'Database schema:' || chr(10) || 'db_' || difficulty) AS prefix
FROM ({Q})""")
def q_prefix_stable_messages(wh):
    schema = F.concat(F.lit("db_"), F.col("difficulty"))
    built = prompts.prefix_stable_messages(F.lit(""), schema, F.col("question"))
    return wh.sql(QUESTIONS).select("qid", built.alias("m")).select(
        "qid", prompts.show_messages(F.col("m")).alias("messages"), prompts.prefix_hash(F.col("m")).alias("prefix"))


O_FEEDBACK = f"""CASE WHEN sql = '' THEN '|user>{prompts.EMPTY_SQL_FEEDBACK}' WHEN error IS NOT NULL
  THEN '|user>DuckDB could not run the query:' || chr(10) || error || {NL2} || 'Please correct it.' ELSE '' END"""


@query("retry_prompt", f"""
SELECT qid, string_agg('assistant>' || sql || {O_FEEDBACK}, '|' ORDER BY attempt) AS messages 
FROM (SELECT *, min(CASE WHEN sql <> '' AND error IS NULL THEN attempt END) OVER (PARTITION BY qid) AS done FROM ({A}) WHERE attempt <= 3)
WHERE attempt <= coalesce(done, 3) GROUP BY qid""")
def q_retry_prompt(wh):
    log = wh.sql(ATTEMPTS).withColumn("raw", F.col("sql"))
    return prompts.retry_messages(log, "qid").select("qid", prompts.show_messages(F.col("turns")).alias("messages"))


@query("retry_question", f"""
SELECT qid, attempt, CASE WHEN error IS NULL THEN 'Q' || qid ELSE 'Q' || qid || {NL2} || 'Last SQL failed: ' || error || '. Fix it.' END AS question FROM ({A})""")
def q_retry_question(wh):
    return wh.sql(ATTEMPTS).select("qid", "attempt", prompts.retry_question(
        F.concat(F.lit("Q"), F.col("qid").cast("string")), F.col("error")).alias("question"))


O_CHAT = f"""['system>{prompts.SYSTEM_PLAIN}', 'user>Schema:' || chr(10) || '{SCHEMA}' || {NL2} || 'Question: ' || question, 'assistant>' || {o_strip('sql')}]"""


@query("chat_example", f"SELECT qid, array_to_string({O_CHAT}, '|') AS messages FROM ({Q})")
def q_chat_example(wh):
    built = prompts.chat_example(SCHEMA, F.col("question"), F.col("sql"))
    return wh.sql(QUESTIONS).select("qid", prompts.show_messages(built).alias("messages"))
