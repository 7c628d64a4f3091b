"""Example selection and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions.difficulty import LEVELS, RULES, with_rule_grade
from sparkassay.functions.vectors import hash_vector
from sparkassay.operators import selection
from sparkassay.operators.features import hash_embed
from sparkassay.plans.fixtures import QUESTIONS
from sparkassay.plans.registry import plain, query
from sparkassay.plans.retrieval import O_VEC, o_rank
from sparkassay.plans.text import o_vectors

Q = plain(QUESTIONS)
ORDER = "CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


@query("fewshot_static", f"""
SELECT difficulty, qid, question, sql FROM (
  SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY qid) AS n FROM ({Q})) WHERE n = 1
ORDER BY {ORDER} LIMIT 3""")
def q_fewshot_static(wh):
    return selection.fewshot_static(wh.sql(QUESTIONS, spread=True), "qid", 3)


USER_TURNS = "SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS turn_id, text FROM conversations WHERE role = 'user'"


@query("fewshot_dynamic", f"""
WITH {o_vectors(USER_TURNS, 'turn_id', name='uv')},
dot AS (SELECT a.turn_id AS q, b.turn_id AS i, sum(a.w * b.w) AS s FROM uv a JOIN uv b USING (b) GROUP BY ALL)
{o_rank(f'''SELECT a.turn_id AS question_id, c.turn_id AS example_id, round(coalesce(s, 0), 6) AS score
  FROM ({USER_TURNS}) a JOIN ({USER_TURNS}) c ON a.text <> c.text LEFT JOIN dot ON q = a.turn_id AND i = c.turn_id''',
  3, 'question_id', 'example_id')}""")
def q_fewshot_dynamic(wh):
    turns = hash_embed(wh.conversations.filter(F.col("role") == "user")
                       .select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text"))
    return selection.fewshot_dynamic(turns, turns, "turn_id", "turn_id", q_out="question_id", i_out="example_id")


def o_count(level: str) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(question), '{p}') AS INT)" for p in RULES[level])


O_GRADED = f"""SELECT qid, question,
    CASE WHEN e + m + h = 0 THEN 'medium' WHEN e >= m AND e >= h THEN 'easy' WHEN m >= h THEN 'medium' ELSE 'hard' END AS difficulty,
    CASE WHEN e + m + h = 0 THEN 0.0 ELSE round_even(CAST(greatest(e, m, h) - (e + m + h - greatest(e, m, h) - least(e, m, h)) AS DOUBLE) / (e + m + h), 3) END AS confidence
  FROM (SELECT qid, question, {o_count('easy')} AS e, {o_count('medium')} AS m, {o_count('hard')} AS h FROM ({Q}))"""


@query("classify_rules", O_GRADED)
def q_classify_rules(wh):
    return with_rule_grade(wh.sql(QUESTIONS, spread=True).select("qid", "question"))


@query("classify_knn", f"""
WITH near AS ({o_rank(O_VEC, 5, 'query_id', 'item_id')}),
votes AS (SELECT query_id, label, count(*) AS v FROM near JOIN embeddings ON vec_id = item_id GROUP BY ALL)
SELECT query_id AS vec_id, label, round_even(v / 5.0, 3)::DOUBLE AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, label) AS n FROM votes) WHERE n = 1""")
def q_classify_knn(wh):
    v = wh.embeddings.select("vec_id", "embedding", "label")
    return selection.classify_knn(v, v, "vec_id", "vec_id", "label")


# The labelled pool: user turns, graded by their conversation.
POOL = """SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS ex_id, text,
  CASE conv_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty
FROM {conversations} WHERE role = 'user'"""
O_ROUTED = f"""g AS ({O_GRADED}), low AS (SELECT qid, question AS text FROM g WHERE confidence < 0.3),
pool AS ({plain(POOL)}),
{o_vectors('SELECT qid, text FROM low', 'qid', name='lv')}, {o_vectors('SELECT ex_id, text FROM pool', 'ex_id', name='pv')},
dot AS (SELECT qid, ex_id, sum(lv.w * pv.w) AS s FROM lv JOIN pv USING (b) GROUP BY ALL),
near AS ({o_rank('''SELECT low.qid, pool.ex_id, round(coalesce(s, 0), 6) AS score FROM low CROSS JOIN pool
   LEFT JOIN dot ON dot.qid = low.qid AND dot.ex_id = pool.ex_id''', 5, 'qid', 'ex_id')}),
votes AS (SELECT qid, difficulty, count(*) AS v FROM near JOIN pool USING (ex_id) GROUP BY ALL),
routed AS (
  SELECT qid, difficulty, confidence, 'rule_based' AS method FROM g WHERE confidence >= 0.3
  UNION ALL
  SELECT qid, difficulty, round_even(v / 5.0, 3)::DOUBLE, 'embedding' FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY v DESC, {ORDER}) AS n FROM votes) WHERE n = 1)"""


@query("route", f"""
WITH {O_ROUTED} SELECT *, CASE WHEN difficulty = 'hard' THEN 'openai/gpt-4o' ELSE 'openai/gpt-4o-mini' END AS model,
  CASE WHEN difficulty = 'easy' THEN 'zero_shot' ELSE 'few_shot_dynamic' END AS strategy FROM routed""")
def q_route(wh):
    pool = wh.sql(POOL).withColumn("embedding", hash_vector("text"))
    return selection.route(wh.sql(QUESTIONS, spread=True), pool, "qid", "ex_id", hard_model="openai/gpt-4o")


@query("routing_table_join", f"""
SELECT qid, difficulty, 'openai/gpt-4o-mini' AS model,
  CASE WHEN difficulty = 'easy' THEN 'zero_shot' ELSE 'few_shot_dynamic' END AS strategy FROM ({Q})""")
def q_routing_table_join(wh):
    return selection.with_route(wh.sql(QUESTIONS, spread=True).select("qid", "difficulty"))


TRAINING = """SELECT o_orderpriority AS run, o_orderkey AS pos,
  CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 0 END AS score, o_custkey % 29 = 0 AS failed FROM {orders}"""


@query("select_demos", f"""
WITH t AS ({plain(TRAINING)}),
stop AS (SELECT run, pos FROM (SELECT run, pos, row_number() OVER (PARTITION BY run ORDER BY pos) AS n FROM t WHERE failed) WHERE n = 3),
f AS (SELECT run, pos, 'bootstrapped' AS kind FROM (
  SELECT t.run, t.pos, row_number() OVER (PARTITION BY t.run ORDER BY t.pos) AS n FROM t LEFT JOIN stop USING (run)
  WHERE score = 1 AND NOT failed AND (stop.pos IS NULL OR t.pos < stop.pos)) WHERE n <= 4),
b AS (SELECT run, pos, kind FROM f UNION ALL SELECT run, pos, 'labelled' FROM t WHERE (run, pos) NOT IN (SELECT run, pos FROM f))
SELECT * FROM (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY kind, pos) AS INT) AS rank, pos, kind FROM b) WHERE rank <= 4""")
def q_select_demos(wh):
    return selection.select_demos(wh.sql(TRAINING), "run", "pos", "score", "failed")
