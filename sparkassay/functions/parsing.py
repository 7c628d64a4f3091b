"""Parsing model output columns: SQL, reasoning, JSON completions, judge verdicts, tool arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkassay.functions.text import SPACE_CLASS, strip

# Flags: ignore case, line anchors, Unix line ends only; dot-all where a body spans lines.
SQL_MARK = rf"(?imd)^SQL:{SPACE_CLASS}*"
REASONING = rf"(?imsd)^Reasoning:{SPACE_CLASS}*\n(.*?)(?=^SQL:)"
FENCE = rf"(?i)```(?:sql)?{SPACE_CLASS}*"


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, FENCE, "")


def extract_sql(raw: Column | str) -> Column:
    """Text after the first line-start marker (the whole text without one), fences removed, stripped."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    parts = F.split(raw, SQL_MARK, 2)
    return strip(without_fences(F.coalesce(F.try_element_at(parts, F.lit(2)), raw)))


def extract_reasoning(raw: Column | str) -> Column:
    """The block between the reasoning marker and the first SQL marker; null when the format is absent."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.when(raw.rlike(REASONING), strip(F.regexp_extract(raw, REASONING, 1)))


# Model-name parts for which JSON-constrained output is used (a vLLM backend always uses it).
JSON_MODEL_PARTS = ("gpt-4o", "gpt-4-turbo", "o1-", "o3-")


def json_mode(model: Column, is_vllm: Column) -> Column:
    named = F.lit(False)
    for part in JSON_MODEL_PARTS:
        named = named | F.lower(model).contains(part)
    return is_vllm | named


def parse_completion(raw: Column, is_cot: Column) -> Column:
    """``struct(sql, reasoning)`` of a JSON-mode completion.

    A JSON object whose ``sql`` is a string (or missing, giving an empty query) is used as is; anything else falls
    back to the marker rules. Reasoning is kept for chain-of-thought rows only.
    """
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    field = F.try_variant_get(v, "$.sql", "variant")
    usable = kind.startswith("OBJECT") & (field.isNull() | (F.schema_of_variant(field) == "STRING"))
    usable = F.coalesce(usable, F.lit(False))
    sql = F.when(usable, strip(F.coalesce(F.try_variant_get(v, "$.sql", "string"), F.lit("")))).otherwise(extract_sql(raw))
    why = F.when(is_cot, F.when(usable, F.try_variant_get(v, "$.reasoning", "string")).otherwise(extract_reasoning(raw)))
    return F.struct(sql.alias("sql"), why.alias("reasoning"))


# Score of each verdict.
VERDICT_SCORES = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def parse_verdict(raw: Column, sql: Column) -> Column:
    """``struct(value, explanation)``: verdicts map to 1 / 0.5 / 0; bad replies and empty SQL score 0."""
    j = F.from_json(raw, "verdict string, reasoning string", {"mode": "PERMISSIVE"})
    table = F.create_map(*[x for k, s in VERDICT_SCORES.items() for x in (F.lit(k), F.lit(s))])
    score = F.when(j["reasoning"].isNotNull(), F.try_element_at(table, j["verdict"]))
    text = F.concat(F.lit("["), F.upper(j["verdict"]), F.lit("] "), j["reasoning"])
    empty = strip(sql) == ""
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0))).alias("value"),
        F.when(empty, F.lit("nothing to judge")).when(score.isNull(), F.lit("unusable verdict")).otherwise(text).alias("explanation"))


# Argument name and default of each tool.
TOOL_ARGUMENT = {"query_database": "sql", "search_knowledge_base": "query", "get_schema": "table_name"}


def parse_tool_args(tool: Column, arguments: Column) -> Column:
    """``struct(value, success, error)`` of one call's JSON arguments."""
    v = F.try_parse_json(arguments)
    value = F.lit(None).cast("string")
    for name, arg in TOOL_ARGUMENT.items():
        got = F.try_variant_get(v, f"$.{arg}", "string")
        value = F.when(tool == name, got if arg == "table_name" else F.coalesce(got, F.lit(""))).otherwise(value)
    known = tool.isin(*TOOL_ARGUMENT)
    error = (F.when(v.isNull(), F.lit("JSON parse error"))
             .when(~known, F.concat(F.lit("Unknown tool: "), tool)))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.isNull().alias("success"), error.alias("error"))
