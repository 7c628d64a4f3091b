"""Prompt and message tables: ordered string building from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.text import strip

EXAMPLES_HEADER = "Worked examples (question, then SQL):"
EXAMPLES_FOOTER = "---\n"
SYSTEM_PLAIN = "You write one DuckDB SELECT statement for the question. Reply with SQL only."
SYSTEM_REASONED = "Explain the tables, joins and filters after a line 'Reasoning:', then give the SQL after a line 'SQL:'."
SCHEMA_NOTED = "Schema received."
EMPTY_SQL_FEEDBACK = "No SQL query was found in the reply. Please give a SQL query."
MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def fewshot_block(pairs: Column) -> Column:
    """Preamble from an ordered array of (question, sql); empty text for an empty or missing array."""
    shown = F.transform(pairs, lambda p: F.concat(F.lit("Question: "), p["question"], F.lit("\nSQL: "), p["sql"]))
    block = F.concat(F.lit(EXAMPLES_HEADER + "\n\n"), F.array_join(shown, "\n\n"), F.lit("\n\n" + EXAMPLES_FOOTER))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) == 0, F.lit("")).otherwise(block)


def ordered_pairs(df: DataFrame, q: str, order: str = "rank", question: str = "question", sql: str = "sql") -> DataFrame:
    """Selected examples per question as an ordered array (as many as were selected, a handful)."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(question).alias("question"), F.col(sql).alias("sql"))))
    return df.groupBy(q).agg(F.transform(
        listed, lambda e: F.struct(e["question"].alias("question"), e["sql"].alias("sql"))).alias("pairs"))


def render_prompt(strategy: Column, block: Column, schema: Column, question: Column) -> Column:
    """``struct(system, user)``; chain-of-thought prompts carry no trailing SQL cue."""
    cot = strategy == "chain_of_thought"
    user = F.concat(block, F.lit("Schema:\n"), schema, F.lit("\n\nQuestion: "), question,
                    F.when(cot, F.lit("")).otherwise(F.lit("\n\nSQL:")))
    system = F.when(cot, F.lit(SYSTEM_REASONED)).otherwise(F.lit(SYSTEM_PLAIN))
    return F.struct(system.alias("system"), user.alias("user"))


def prefix_stable_messages(block: Column, schema: Column, question: Column) -> Column:
    """Four messages whose first two depend on the schema alone."""
    return F.array(
        message("system", F.lit(SYSTEM_PLAIN)),
        message("user", F.concat(F.lit("Database schema:\n"), schema)),
        message("assistant", F.lit(SCHEMA_NOTED)),
        message("user", F.concat(block, F.lit("Question: "), question, F.lit("\n\nSQL:"))))


def prefix_hash(messages: Column, n: int = 2) -> Column:
    """Digest of the shared prefix, for grouping or sorting requests so equal prefixes run together."""
    return F.sha2(F.array_join(F.transform(F.slice(messages, 1, n), lambda m: F.concat(
        m["role"], F.lit("\x1f"), m["content"])), "\x1e"), 256)


def retry_feedback(sql: Column, error: Column) -> Column:
    return F.when(strip(F.coalesce(sql, F.lit(""))) == "", F.lit(EMPTY_SQL_FEEDBACK)).when(
        error.isNotNull(), F.concat(F.lit("DuckDB could not run the query:\n"), error, F.lit("\n\nPlease correct it.")))


def retry_messages(attempts: DataFrame, q: str, raw: str = "raw", max_retries: int = 3) -> DataFrame:
    """What each question's conversation gained from its attempts: reply, then feedback where it failed.

    Attempts after the first one without feedback never happened for the conversation.
    At most ``max_retries`` attempts per question exist, which bounds the ordered array.
    """
    feedback = retry_feedback(F.col("sql"), F.col("error"))
    own = F.concat(F.array(message("assistant", F.col(raw))),
                   F.when(feedback.isNotNull(), F.array(message("user", feedback)))
                   .otherwise(F.array().cast(MESSAGES)))
    turns = attempts.filter(F.col("attempt") <= max_retries).select(
        q, F.struct("attempt", own.alias("m")).alias("_t"), F.when(feedback.isNull(), F.col("attempt")).alias("_ok"))
    ended = turns.groupBy(q).agg(F.sort_array(F.collect_list("_t")).alias("_t"), F.coalesce(F.min("_ok"), F.lit(max_retries)).alias("_last"))
    return ended.select(q, F.flatten(F.transform(
        F.filter("_t", lambda t: t["attempt"] <= F.col("_last")), lambda t: t["m"])).alias("turns"))


def retry_question(question: Column, error: Column) -> Column:
    """The form that appends the failure to the question text instead."""
    return F.when(error.isNull(), question).otherwise(
        F.concat(question, F.lit("\n\nLast SQL failed: "), error, F.lit(". Fix it.")))


def chat_example(schema: str, question: Column, sql: Column) -> Column:
    """System, user and assistant triple with a constant schema text."""
    return F.array(message("system", F.lit(SYSTEM_PLAIN)),
                   message("user", F.concat(F.lit(f"Schema:\n{schema}\n\nQuestion: "), question)),
                   message("assistant", strip(sql)))


def render_training_text(messages: Column, template: tuple[str, str, str] = ("<|", "|>\n", "\n")) -> Column:
    """Messages as one string: open + role + close + content + end for each."""
    opening, closing, end = template
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(opening), m["role"], F.lit(closing), m["content"], F.lit(end))), "")


def show_messages(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(">"), m["content"])), "|")
