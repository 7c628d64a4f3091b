"""Screening queries over question texts and generated statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import screening as sc
from sparkassay.functions.text import strip
from sparkassay.plans.fixtures import AUDITS, SCREEN, STATEMENTS
from sparkassay.plans.registry import plain, query
from sparkassay.plans.text import o_strip

S = plain(SCREEN)
PERSONA = ("len(list_filter(regexp_extract_all(t, '(?is)\\bact\\s+as\\s(.{0,8})', 1), "
           "lambda x: NOT regexp_matches(x, '(?i)^(sql|database|analyst)'))) > 0")


def o_first(patterns) -> str:
    arms = []
    for pattern, name in patterns:
        cond = PERSONA if "(?!" in pattern else f"regexp_matches(t, '(?i){pattern}')"
        arms.append(f"WHEN {cond} THEN '{name}'")
    return f"CASE {' '.join(arms)} END"


@query("screen_sql_injection", f"SELECT text_id, {o_first(sc.SQL_INJECTION)} AS hit FROM (SELECT text_id, text AS t FROM ({S}))")
def q_screen_sql_injection(wh):
    return wh.sql(SCREEN, spread=True).select("text_id", sc.sql_injection(F.col("text")).alias("hit"))


@query("screen_prompt_injection", f"SELECT text_id, {o_first(sc.PROMPT_INJECTION)} AS hit FROM (SELECT text_id, text AS t FROM ({S}))")
def q_screen_prompt_injection(wh):
    return wh.sql(SCREEN, spread=True).select("text_id", sc.prompt_injection(F.col("text")).alias("hit"))


@query("check_input", f"""
SELECT text_id, category IS NULL AS passed, category,
  CASE category WHEN 'empty_input' THEN 'blank text' WHEN 'sql_injection' THEN s WHEN 'prompt_injection' THEN p END AS reason
FROM (SELECT *, CASE WHEN t = '' THEN 'empty_input' WHEN s IS NOT NULL THEN 'sql_injection' WHEN p IS NOT NULL THEN 'prompt_injection' END AS category
  FROM (SELECT text_id, t, {o_first(sc.SQL_INJECTION)} AS s, {o_first(sc.PROMPT_INJECTION)} AS p
        FROM (SELECT text_id, {o_strip('text')} AS t FROM ({S}))))""")
def q_check_input(wh):
    return wh.sql(SCREEN, spread=True).select("text_id", sc.check_input("text").alias("v")).select("text_id", "v.*")


ALLOW = ("customer", "orders", "lineitem", "part")
O_AUDIT = plain(AUDITS)


# Statements of one task: a fold over tokens takes some hundred microseconds a statement.
STATEMENT_ROWS = 25_000


def statements(wh):
    return wh.sql(STATEMENTS, spread=True, most=STATEMENT_ROWS)


def allow():
    return F.array(*[F.lit(t) for t in ALLOW])


@query("audit_statement_kind", f"""
SELECT sid, CASE WHEN blank THEN 'parse_error' WHEN kind IS NOT NULL THEN 'disallowed_statement' END AS category,
  CASE WHEN blank THEN 'no statement' ELSE kind END AS reason FROM ({O_AUDIT})""")
def q_audit_statement_kind(wh):
    verdict = F.transform(F.array(sc.audit_statements(strip("sql"))), sc.statement_kind)[0]
    return statements(wh).select("sid", verdict.alias("v")).select("sid", "v.*")


@query("audit_table_scope", f"SELECT sid, outside, tables FROM ({O_AUDIT})")
def q_audit_table_scope(wh):
    facts = F.transform(F.array(sc.audit_statements(strip("sql"))), lambda a: F.struct(
        sc.table_scope(a, allow()).alias("outside"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.transform(a, lambda s: s["tables"])))), ",").alias("tables")))[0]
    return (statements(wh).select("sid", facts.alias("v")).select("sid", "v.outside", F.nullif("v.tables", F.lit("")).alias("tables")))


@query("check_output", f"""
SELECT sid, category IS NULL AS passed, category, CASE category WHEN 'empty_output' THEN 'blank statement'
  WHEN 'disallowed_statement' THEN kind WHEN 'schema_violation' THEN outside END AS reason
FROM (SELECT *, CASE WHEN blank THEN 'empty_output' WHEN kind IS NOT NULL THEN 'disallowed_statement'
    WHEN outside IS NOT NULL THEN 'schema_violation' END AS category FROM ({O_AUDIT}))""")
def q_check_output(wh):
    return statements(wh).select("sid", sc.check_output("sql", allow()).alias("v")).select("sid", "v.*")
