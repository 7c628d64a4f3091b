"""Run-log analytics: attempt, tool-call and event folds, leaderboards, gates, sweeps and cost.

Folds are combinable aggregates (or two levels of them), never a window over one request's whole history, so a
request that holds a large share of the log does not land in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.operators.relational import top_per_group

MAX_RETRIES = 3
MAX_TOOL_ROUNDS = 10
RESULT_CHARS = 500
NO_ANSWER = "no final answer"

# Default gate thresholds.
THRESHOLDS = {"syntax_valid": 0.90, "execution_ok": 0.80, "result_match": 0.60, "semantic_judge": 0.73}
# Average tokens per table definition and per question in a retrieval run.
TOKENS_PER_TABLE = 15
TOKENS_PER_QUESTION = 20


def fold_attempts(log: DataFrame, q: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """One row per question: attempts up to the first success or the retry limit, and their sums.

    Only attempts 1..max_retries can count, so each is a conditional aggregate and one pass does everything.
    """
    counted = log.filter(F.col("attempt") <= max_retries)
    last = F.col("_last")
    per_try = [agg for n in range(1, max_retries + 1) for agg in (
        F.sum(F.when(F.col("attempt") == n, F.col("prompt_tokens"))).alias(f"_p{n}"),
        F.sum(F.when(F.col("attempt") == n, F.col("completion_tokens"))).alias(f"_c{n}"),
        F.sum(F.when(F.col("attempt") == n, F.col("cost"))).alias(f"_k{n}"),
        F.max(F.when(F.col("attempt") == n, F.struct("sql", "error"))).alias(f"_s{n}"))]
    folded = counted.groupBy(q).agg(
        F.least(F.min(F.when(F.col("error").isNull(), F.col("attempt"))), F.max("attempt")).alias("_last"), *per_try)

    def upto(prefix: str) -> Column:
        parts = [F.when(last >= n, F.coalesce(F.col(f"{prefix}{n}"), F.lit(0))).otherwise(F.lit(0))
                 for n in range(1, max_retries + 1)]
        return reduce(lambda a, b: a + b, parts)

    at_last = F.coalesce(*[F.when(last == n, F.col(f"_s{n}")) for n in range(1, max_retries + 1)])
    return folded.select(
        q, at_last["sql"].alias("sql"), at_last["error"].alias("error"), last.alias("attempts"),
        upto("_p").alias("prompt_tokens"), upto("_c").alias("completion_tokens"), upto("_k").alias("cost"))


def tool_trace(calls: DataFrame, q: str, sql_value: Column, max_rounds: int = MAX_TOOL_ROUNDS, call: str = "call") -> DataFrame:
    """Per question: number of calls, tools used, last database statement, rounds, and whether the cap was hit.

    A round (``iteration``) may make several calls; ``call`` numbers them in it.
    """
    is_db = F.col("tool") == "query_database"
    return calls.groupBy(q).agg(
        F.count("*").alias("n_calls"),
        F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"),
        F.max_by(F.when(is_db, sql_value), F.when(is_db & sql_value.isNotNull(), F.struct("iteration", call))).alias("last_sql"),
        F.max("iteration").alias("iterations"),
        F.when(F.max("iteration") >= max_rounds, F.lit(NO_ANSWER)).alias("note"))


def cut_results(calls: DataFrame, column: str = "result", chars: int = RESULT_CHARS) -> DataFrame:
    """The log form of a call keeps the first ``chars`` characters of its result (a display limit)."""
    return calls.withColumn(column, F.left(column, F.lit(chars)))


def fold_events(events: DataFrame, request: str, at: str, order: str, bucket: str = "1 hour") -> DataFrame:
    """Rebuild each request: text since its last retry, retries, terminal status, elapsed seconds.

    Level one folds a time bucket of a request, level two the request's bucket summaries in order. A summary
    carries the bucket's text after its last retry, so nothing older has to be kept once a later retry is seen.
    """
    kind = F.col("kind")
    pos = F.struct(at, order)
    entries = F.sort_array(F.collect_list(F.when(kind.isin("sql_token", "retry"), F.struct(
        F.col(at), F.col(order), kind.alias("kind"), F.coalesce("content", F.lit("")).alias("content")))))
    level1 = events.groupBy(request, F.window(F.col(at).cast("timestamp"), bucket)["start"].alias("_b")).agg(
        entries.alias("_e"), F.max(F.when(kind == "retry", pos)).alias("_r"), F.count_if(kind == "retry").alias("_n"),
        F.max(F.when(kind.isin("done", "error"), F.struct(pos.alias("p"), kind.alias("kind")))).alias("_t"),
        F.min(at).alias("_first"), F.max(at).alias("_last"))
    tail = F.filter("_e", lambda e: (e["kind"] == "sql_token") & (
        F.col("_r").isNull() | (F.struct(e[at], e[order]) > F.col("_r"))))
    level1 = level1.withColumn("_text", F.array_join(F.transform(tail, lambda e: e["content"]), "")).drop("_e")
    level2 = level1.groupBy(request).agg(
        F.sort_array(F.collect_list(F.struct("_b", (F.col("_n") > 0).alias("cut"), "_text"))).alias("_parts"),
        F.sum("_n").alias("retries"), F.max("_t")["kind"].alias("status"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    text = F.aggregate("_parts", F.lit(""), lambda acc, p: F.when(p["cut"], p["_text"]).otherwise(
        F.concat(acc, p["_text"])))
    seconds = F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    return level2.select(request, text.alias("sql_text"), "retries", "status",
                         F.round(seconds / 1e6, 3).alias("latency"))


JOB_METRICS = ("result_match", "semantic_judge", "retrieval_recall", "avg_latency", "avg_cost", "avg_attempts",
               "avg_tool_calls")


def status_rollup() -> Column:
    """running if anything is pending or running, else failed, else done, else pending."""
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    return (F.when(has("pending", "running"), F.lit("running")).when(has("failed"), F.lit("failed"))
            .when(has("completed"), F.lit("done")).otherwise(F.lit("pending")))


def leaderboard(jobs: DataFrame, by: str = "strategy", metrics: tuple[str, ...] = JOB_METRICS) -> DataFrame:
    """Unweighted mean over completed jobs of every metric (nulls ignored), job counts and rolled-up status."""
    done = F.col("status") == "completed"
    means = [F.avg(F.when(done, F.col(m))).cast("double").alias(m) for m in metrics]
    return jobs.groupBy(by).agg(F.count("*").alias("total_jobs"), status_rollup().alias("status"), *means)


def sort_nulls_last(df: DataFrame, metric: str, descending: bool, tie: str) -> DataFrame:
    c = F.col(metric)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def model_alias(model: Column) -> Column:
    """Provider alias used by the evaluation harness."""
    return F.regexp_replace(model, "^gemini/", "google/")


def strategy_summary(scores: DataFrame, rows: list[str], scorers: list[str]) -> DataFrame:
    """One row per model and strategy, one text column per scorer: mean to three digits, ``-`` when missing."""
    wide = scores.groupBy(*rows).pivot("scorer", scorers).agg(F.avg("value"))
    shown = [F.coalesce(F.bround(F.col(s), 3).cast("decimal(18,3)").cast("string"), F.lit("-")).alias(s) for s in scorers]
    return wide.select(*rows, *shown)


def gate(scores: DataFrame, run: str, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Per run and scorer: four-digit mean against its threshold; a scorer without a value fails.

    The scorers are known, so each is a conditional mean and the verdicts are unpivoted afterwards.
    """
    means = scores.groupBy(run).agg(*[
        F.bround(F.avg(F.when(F.col("scorer") == s, F.col("value"))), 4).alias(s) for s in thresholds])
    rows = means.unpivot([run], list(thresholds), "scorer", "actual")
    limit = F.create_map(*[x for s, t in thresholds.items() for x in (F.lit(s), F.lit(t))])
    judged = rows.withColumn("threshold", limit[F.col("scorer")])
    return judged.withColumn("passed", F.col("actual").isNotNull() & (F.col("actual") >= F.col("threshold")))


def gate_verdict(gated: DataFrame, run: str) -> DataFrame:
    """Overall flag and the sorted list of failing scorers per run."""
    return gated.groupBy(run).agg(
        F.bool_and("passed").alias("passed"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("scorer")))), ",").alias("failures"))


def rank_configs(table: DataFrame) -> DataFrame:
    """Best first: recall, perfect share, then fastest; ``table`` is one row per configuration."""
    return table.orderBy(F.desc("recall"), F.desc("perfect_recall"), "avg_query_time", "config")


def takeaways(table: DataFrame) -> DataFrame:
    """Best overall, fastest, and best free configuration in one aggregate."""
    quality = F.struct("recall", "perfect_recall", -F.col("avg_query_time"), -F.col("config"))
    speed = F.struct(-F.col("avg_query_time"), -F.col("config"))
    free = (F.col("cost") == 0) & (F.col("strategy") != "sparse")
    return table.agg(
        F.max_by("config", quality).alias("best_overall"), F.max_by("config", speed).alias("fastest"),
        F.max_by(F.when(free, F.col("config")), F.when(free, F.struct(F.col("recall"), -F.col("config")))).alias("best_free"))


def best_by_strategy_k(table: DataFrame, ks: list[int]) -> DataFrame:
    return table.groupBy("strategy").pivot("top_k", ks).agg(F.max("recall"))


def cost_estimate(n_tables: Column, n_questions: Column, price_per_1k: Column) -> Column:
    return (n_tables * TOKENS_PER_TABLE + n_questions * TOKENS_PER_QUESTION) / F.lit(1000.0) * price_per_1k


def recall_status(recall: Column) -> Column:
    return F.when(recall == 1, F.lit("full")).when(recall > 0, F.lit("partial")).otherwise(F.lit("none"))


def part_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means per question part and strategy; a failed row counts as 0 in every metric."""
    means = [F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics]
    return rows.groupBy("part", "strategy").agg(F.count("*").alias("n"), *means)


def token_cost_rollup(rows: DataFrame, run: str, strategy: str) -> DataFrame:
    """Total tokens and cost per run and strategy, per run, and overall."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return rows.rollup(run, strategy).agg(
        F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"), F.sum("cost").cast("double").alias("cost"),
        F.count("*").alias("n_questions"))


def pending_runs(requested: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Requested combinations without a completed job; running and failed ones are queued again."""
    done = jobs.filter(F.col("status") == "completed").select(*keys).distinct()
    return requested.join(done, keys, "left_anti")


def finished_runs(jobs: DataFrame) -> DataFrame:
    """The rows worth caching between sessions."""
    return jobs.filter(F.col("status").isin("completed", "failed"))


def best_questions(per_question: DataFrame, best: DataFrame) -> DataFrame:
    """Per-question status of the winning configuration (``best`` has one row)."""
    return (per_question.join(F.broadcast(best), "config").select("config", "qid", recall_status(F.col("recall")).alias("status")))


