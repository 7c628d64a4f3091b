"""Result-set comparison over the long form ``(question, row_no, cells)``.

Every comparison is two combinable aggregates: rows are first reduced per distinct row, then per question. No
question is ever collected, so one question may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions.text import is_blank, strip
from sparkassay.operators.relational import top_per_group

PREVIEW_ROWS = 50
JUDGE_ROWS = 10


def cell(c: Column, dtype: T.DataType) -> Column:
    """Canonical text of one value: numbers to two digits (10 equals 10.0), strings stripped, dates as ISO text.

    Numbers and strings carry different tags, so the text "10" never equals the number 10; null stays null.
    """
    if isinstance(dtype, T.NumericType):
        exact = c.cast("decimal(38,2)") if isinstance(dtype, T.IntegralType) else F.bround(c, 2).cast("decimal(38,2)")
        return F.concat(F.lit("n:"), exact.cast("string"))
    if isinstance(dtype, T.DateType):
        return F.concat(F.lit("s:"), F.date_format(c, "yyyy-MM-dd"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit("s:"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    if isinstance(dtype, T.BooleanType):
        return F.concat(F.lit("b:"), c.cast("string"))
    return F.concat(F.lit("s:"), strip(c.cast("string")))


def normalize_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    cells = [cell(F.col(c), df.schema[c].dataType) for c in columns]
    return df.select(*keys, F.array(*cells).alias("cells"))


def render_cells(cells: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(cells, ", ", "null"), F.lit(")"))


def compare_rows(actual: DataFrame, expected: DataFrame, q: str, ordered: bool = False) -> DataFrame:
    """Per question: ``equal``, row counts, and the width of each side's first row.

    Unordered equality is multiset equality; ordered equality also requires the same row positions.
    """
    side = lambda df, sign: df.select(q, "row_no", "cells", F.lit(sign).alias("_s"))
    both = side(actual, 1).unionByName(side(expected, -1))
    key = [q, "cells"] + (["row_no"] if ordered else [])
    mine, theirs = F.col("_s") == 1, F.col("_s") == -1
    per_row = both.groupBy(*key).agg(
        F.sum("_s").alias("_d"), F.count_if(mine).alias("_na"), F.count_if(theirs).alias("_ne"),
        F.min(F.when(mine, F.col("row_no"))).alias("_fa"), F.min(F.when(theirs, F.col("row_no"))).alias("_fe"))
    width = F.size("cells")
    return per_row.groupBy(q).agg(
        F.bool_and(F.col("_d") == 0).alias("equal"),
        F.sum("_na").alias("n_actual"), F.sum("_ne").alias("n_expected"),
        F.min_by(width, "_fa").alias("width_actual"), F.min_by(width, "_fe").alias("width_expected"))


def _usable() -> Column:
    return ~is_blank(F.coalesce("sql", F.lit(""))) & F.col("error").isNull()


def result_match(executions: DataFrame, actual: DataFrame, expected: DataFrame, q: str) -> DataFrame:
    """1.0 for equal multisets, 0.5 for equal shape, else 0.0; a failed or empty execution scores 0.0."""
    cmp = compare_rows(actual, expected, q)
    same_shape = ((F.col("n_actual") == F.col("n_expected")) & (F.col("n_actual") > 0)
                  & (F.col("width_actual") == F.col("width_expected")))
    score = (F.when(~_usable(), F.lit(0.0)).when(F.coalesce("equal", F.lit(True)), F.lit(1.0))
             .when(same_shape, F.lit(0.5)).otherwise(F.lit(0.0)))
    return executions.select(q, "sql", "error").join(cmp, q, "left").select(q, score.alias("value"))


def strict_match(executions: DataFrame, actual: DataFrame, expected: DataFrame, q: str) -> DataFrame:
    """1 only for the same rows in the same positions."""
    cmp = compare_rows(actual, expected, q, ordered=True).select(q, "equal")
    score = F.when(_usable() & F.coalesce("equal", F.lit(True)), 1).otherwise(0)
    return executions.select(q, "sql", "error").join(cmp, q, "left").select(q, score.alias("value"))


def execution_ok(executions: DataFrame, q: str) -> DataFrame:
    return executions.select(q, F.when(_usable(), 1).otherwise(0).alias("value"))


def preview(rows: DataFrame, q: str, k: int) -> DataFrame:
    """Per question: total row count and its first k rendered rows, in order (k is the report size)."""
    totals = rows.groupBy(q).agg(F.count("*").alias("row_count"))
    first = top_per_group(rows.select(q, "row_no", "cells"), [q], [F.col("row_no"), F.col("cells")], k, "_n")
    listed = first.groupBy(q).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_n", "cells"))), lambda s: s["cells"]).alias("rows"))
    return totals.join(listed, q)


# What callers match on in a preview.
ERROR_PREFIX = "SQL ERROR: "
NO_ROWS = "Query executed successfully. No rows returned."


def result_preview(executions: DataFrame, rows: DataFrame, q: str, k: int = PREVIEW_ROWS) -> DataFrame:
    """JSON with row count, truncation flag and first k rows; fixed messages for empty results and errors."""
    body = F.to_json(F.struct(F.col("row_count"), (F.col("row_count") > k).alias("truncated"), F.col("rows")))
    text = (F.when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_PREFIX), F.col("error")))
            .when(F.col("row_count").isNull(), F.lit(NO_ROWS))
            .otherwise(body))
    return executions.select(q, "error").join(preview(rows, q, k), q, "left").select(q, text.alias("result"))


def records_null_filled(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each row as a JSON record with every value as text and nulls as empty strings."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    return df.select(*keys, F.to_json(F.struct(*filled)).alias("record"))


def judge_prompt(executions: DataFrame, actual: DataFrame, expected: DataFrame, q: str, k: int = JUDGE_ROWS) -> DataFrame:
    """Question, statement, and the first k rows of both results, noting the total when rows were left out."""

    def shown(rows: DataFrame, name: str) -> DataFrame:
        text = F.concat(F.lit("["), F.array_join(F.transform("rows", render_cells), ", "), F.lit("]"),
                        F.when(F.col("row_count") > k, F.format_string("  ... (%d rows total)", "row_count"))
                        .otherwise(F.lit("")))
        return preview(rows, q, k).select(q, text.alias(name))

    got = F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), F.col("error"))).otherwise(
        F.coalesce("_got", F.lit("[]")))
    prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nSQL:\n"), F.col("sql"),
                      F.lit("\n\nResult:\n"), got, F.lit("\n\nExpected:\n"), F.coalesce("_want", F.lit("[]")))
    return (executions.filter(~is_blank("sql")).join(shown(actual, "_got"), q, "left")
            .join(shown(expected, "_want"), q, "left").select(q, prompt.alias("prompt")))
