"""Queries that parse raw model output columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import parsing
from sparkassay.functions.text import SPACE_CLASS
from sparkassay.plans.fixtures import COMPLETIONS, TOOL_CALLS, VERDICTS
from sparkassay.plans.registry import plain, query
from sparkassay.plans.text import o_strip

C, V, TC = plain(COMPLETIONS), plain(VERDICTS), plain(TOOL_CALLS)
MARK = rf"(?ims)^SQL:{SPACE_CLASS}*(.*)"
BODY = f"CASE WHEN regexp_matches(raw, '(?im)^SQL:') THEN regexp_extract(raw, '{MARK}', 1) ELSE raw END"
O_SQL = o_strip(f"regexp_replace({BODY}, '(?i)```(?:sql)?{SPACE_CLASS}*', '', 'g')")
WHY = rf"(?ims)^Reasoning:{SPACE_CLASS}*\n(.*?)^SQL:"
O_WHY = f"CASE WHEN regexp_matches(raw, '{WHY}') THEN {o_strip(f'''regexp_extract(raw, '{WHY}', 1)''')} END"


@query("extract_sql", f"SELECT cid, {O_SQL} AS sql FROM ({C})")
def q_extract_sql(wh):
    return wh.sql(COMPLETIONS, spread=True).select("cid", parsing.extract_sql("raw").alias("sql"))


@query("extract_reasoning", f"SELECT cid, {O_WHY} AS reasoning FROM ({C})")
def q_extract_reasoning(wh):
    return wh.sql(COMPLETIONS, spread=True).select("cid", parsing.extract_reasoning("raw").alias("reasoning"))


@query("parse_completion_json", f"""
SELECT cid, CASE WHEN ok THEN {o_strip("coalesce(j->>'$.sql', '')")} ELSE {O_SQL} END AS sql,
  CASE WHEN is_cot THEN (CASE WHEN ok THEN j->>'$.reasoning' ELSE {O_WHY} END) END AS reasoning
FROM (SELECT *, coalesce(json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.sql'), 'VARCHAR') = 'VARCHAR', false) AS ok
      FROM (SELECT *, TRY_CAST(raw AS JSON) AS j FROM ({C})))""")
def q_parse_completion_json(wh):
    parsed = parsing.parse_completion(F.col("raw"), F.col("is_cot"))
    return wh.sql(COMPLETIONS, spread=True).select("cid", parsed.alias("p")).select("cid", "p.sql", "p.reasoning")


@query("parse_verdict", f"""
SELECT cid, CASE WHEN sql = '' THEN 0.0::DOUBLE ELSE coalesce(score, 0.0) END AS value,
  CASE WHEN sql = '' THEN 'nothing to judge' WHEN score IS NULL THEN 'unusable verdict'
    ELSE '[' || upper(v) || '] ' || r END AS explanation
FROM (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN v = 'correct' THEN 1.0::DOUBLE WHEN v = 'partial' THEN 0.5 WHEN v = 'incorrect' THEN 0.0 END AS score
  FROM (SELECT cid, sql, j->>'$.verdict' AS v, j->>'$.reasoning' AS r FROM (SELECT *, TRY_CAST(raw AS JSON) AS j FROM ({V}))))""")
def q_parse_verdict(wh):
    scored = parsing.parse_verdict(F.col("raw"), F.col("sql"))
    return wh.sql(VERDICTS, spread=True).select("cid", scored.alias("p")).select("cid", "p.value", "p.explanation")


@query("parse_tool_args", f"""
SELECT qid, iteration, tool, CASE WHEN j IS NULL OR tool = 'send_mail' THEN NULL
    WHEN tool = 'query_database' THEN coalesce(j->>'$.sql', '') WHEN tool = 'search_knowledge_base' THEN coalesce(j->>'$.query', '')
    ELSE j->>'$.table_name' END AS value,
  j IS NOT NULL AND tool <> 'send_mail' AS success,
  CASE WHEN j IS NULL THEN 'JSON parse error' WHEN tool = 'send_mail' THEN 'Unknown tool: send_mail' END AS error
FROM (SELECT *, TRY_CAST(arguments AS JSON) AS j FROM ({TC}))""")
def q_parse_tool_args(wh):
    parsed = parsing.parse_tool_args(F.col("tool"), F.col("arguments"))
    return wh.sql(TOOL_CALLS, spread=True).select("qid", "iteration", "tool", parsed.alias("p")).select(
        "qid", "iteration", "tool", "p.value", "p.success", "p.error")
