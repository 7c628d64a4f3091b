"""Per-question score columns and run-level means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.parsing import VERDICT_SCORES
from sparkassay.functions.screening import audit_statements


def share(hits: Column, total: Column) -> Column:
    """hits / total, 1.0 when nothing was required."""
    return F.when(total == 0, F.lit(1.0)).otherwise(hits / total)


def table_recall_substring(golden_sql: Column, retrieved: Column) -> Column:
    """Share of the golden statement's tables whose ``name(`` occurs in some retrieved definition.

    No retrieval counts as 1.0 (the full schema was used); an unreadable golden statement as 0.0.
    """

    def score(s: Column) -> Column:
        required = F.array_distinct(F.flatten(F.transform(s["a"], lambda x: x["tables"])))
        found = F.filter(required, lambda t: F.exists(retrieved, lambda d: F.lower(d).contains(F.concat(t, F.lit("(")))))
        return (F.when(s["a"][0]["blank"], F.lit(0.0)).when(F.coalesce(F.size(retrieved), F.lit(0)) == 0, F.lit(1.0))
                .otherwise(share(F.size(found), F.size(required))))

    return F.transform(F.array(F.struct(audit_statements(golden_sql).alias("a"))), score)[0]


def recall_at_k(retrieved: Column, required: Column) -> Column:
    """Share of required names present among the retrieved names."""
    return share(F.size(F.filter(required, lambda r: F.array_contains(retrieved, r))), F.size(required))


def phrase_recall(texts: Column, phrases: Column) -> Column:
    """1.0 if any phrase occurs, ignoring case, in the space-joined texts."""
    body = F.lower(F.array_join(texts, " "))
    return F.when(F.exists(phrases, lambda p: body.contains(F.lower(p))), F.lit(1.0)).otherwise(F.lit(0.0))


def keyword_hits(answer: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.lower(answer).contains(F.lower(k))))


def keyword_quality(answer: Column, keywords: Column, verdict: Column, judged: Column) -> Column:
    """0 without any keyword; else the judge's verdict, or the keyword share where the judge failed."""
    hits = keyword_hits(answer, keywords)
    table = F.create_map(*[x for k, s in VERDICT_SCORES.items() for x in (F.lit(k), F.lit(s))])
    ruled = F.coalesce(F.try_element_at(table, verdict), F.lit(0.0))
    return (F.when(F.coalesce(answer, F.lit("")) == "", F.lit(0.0)).when(hits == 0, F.lit(0.0))
            .when(judged, ruled).otherwise(F.least(hits / F.size(keywords), F.lit(1.0))))


def data_present(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(r"(?U)\d")


def run_means(df: DataFrame, keys: list[str], tool_calls: Column | None = None) -> DataFrame:
    """Means with the defaults of unlogged values: attempts 1, cost and latency 0, tokens 0, no tool calls.

    ``tool_calls`` is the number of calls; by default the size of the ``tool_calls`` array.
    """
    calls = F.size("tool_calls") if tool_calls is None else tool_calls
    mean = lambda c, default: (F.sum(F.coalesce(c, F.lit(default)).cast("decimal(28,6)")).cast("double")
                               / F.count("*"))
    tokens = F.coalesce(F.col("prompt_tokens") + F.col("completion_tokens"), F.lit(0))
    return df.groupBy(*keys).agg(
        mean(F.col("attempts"), 1).alias("avg_attempts"), mean(F.col("cost"), 0).alias("avg_cost"),
        mean(F.col("latency"), 0).alias("avg_latency"), mean(tokens, 0).alias("avg_total_tokens"),
        mean(calls, 0).alias("avg_tool_calls"))


def diagnostic_faithfulness(context: Column, supplied: Column) -> Column:
    """Supplied score, or 1.0 where there was no retrieved context to be faithful to."""
    return F.when(F.coalesce(F.size(context), F.lit(0)) == 0, F.lit(1.0)).otherwise(supplied)


def long_scores(df: DataFrame, keys: list[str], scorers: list[str]) -> DataFrame:
    """Wide score columns as ``(keys, scorer, value)`` rows."""
    return df.unpivot(keys, scorers, "scorer", "value")


def scorecard(scores: DataFrame, run: list[str]) -> DataFrame:
    """Mean per run and scorer (partial credit counts as 0.5), nulls left out of the mean, and sample counts."""
    return scores.groupBy(*run, "scorer").agg(
        F.avg("value").alias("mean"), F.count("*").alias("total_samples"))


def score_maps(card: DataFrame, run: list[str], metric: str = "accuracy") -> DataFrame:
    """One map of maps per run: scorer -> metric name -> value. Its size is the number of scorers."""
    return card.groupBy(*run).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("scorer", "mean"))).cast(
            "array<struct<key:string,value:double>>")).alias("_m"), F.max("total_samples").alias("total_samples")
    ).withColumn("scores", F.transform_values("_m", lambda k, v: F.create_map(F.lit(metric), v))).drop("_m")


# Score name -> the function that produces its values and the columns it reads.
SCORERS = {
    "retrieval_recall": (table_recall_substring, ("golden_sql", "retrieved_defs")),
    "recall_at_k": (recall_at_k, ("retrieved", "required")),
    "phrase_recall": (phrase_recall, ("texts", "phrases")),
    "data_present": (lambda text: data_present(text).cast("double"), ("answer",)),
}


def score_by_name(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``*keys, scorer, value``: the named scores of every row, one pass over the rows; an unknown name is an error."""
    unknown = sorted(set(names) - set(SCORERS))
    if unknown:
        raise ValueError(f"unknown scorers {unknown}")
    values = [F.struct(F.lit(n).alias("scorer"), SCORERS[n][0](*[F.col(c) for c in SCORERS[n][1]]).cast("double").alias("value")) for n in names]
    return rows.select(*keys, F.inline(F.array(*values)))
