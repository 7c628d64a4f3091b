"""Streaming queries, each drained to its current end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import screening as sc
from sparkassay.functions.difficulty import RULES
from sparkassay.operators import retrieval
from sparkassay.operators.features import hash_embed
from sparkassay.plans.fixtures import STREAM
from sparkassay.plans.registry import plain, query
from sparkassay.plans.retrieval import o_dense
from sparkassay.plans.screening import o_first
from sparkassay.plans.text import DOCS, o_strip
from sparkassay.session import materialize
from sparkassay.streaming import streams


def o_count(level: str) -> str:
    return " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INT)" for p in RULES[level])


@query("stream_screen_route", f"""
SELECT conv_id, turn, category IS NULL AS passed, category, CASE WHEN category IS NOT NULL THEN NULL
  WHEN e + m + h = 0 THEN 'medium' WHEN e >= m AND e >= h THEN 'easy' WHEN m >= h THEN 'medium' ELSE 'hard' END AS difficulty
FROM (SELECT conv_id, turn, {o_count('easy')} AS e, {o_count('medium')} AS m, {o_count('hard')} AS h,
  CASE WHEN t = '' THEN 'empty_input' WHEN {o_first(sc.SQL_INJECTION)} IS NOT NULL THEN 'sql_injection' WHEN {o_first(sc.PROMPT_INJECTION)} IS NOT NULL THEN 'prompt_injection' END AS category
  FROM (SELECT conv_id, turn, text, {o_strip('text')} AS t FROM conversations))""")
def q_stream_screen_route(wh):
    turns = streams.table_stream(wh.spark, wh.root, "conversations")
    return streams.drain_to_table(streams.screen_and_grade(turns, ["conv_id", "turn"], "text"), "screened")


def event_stream(wh):
    events = streams.table_stream(wh.spark, wh.root, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


# A window is reported once the watermark (latest event minus the delay) has passed its end.
CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)"


STRATEGY = "CASE event_id % 4 WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot_dynamic' WHEN 2 THEN 'rag' ELSE 'tool_use' END"


def o_windows(size_h: int, slide_h: int) -> str:
    """All windows, open ones too."""
    offsets = ", ".join(f"({i})" for i in range(size_h // slide_h))
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, strategy, count(*) AS n,
      round(CAST(sum(v) AS DOUBLE) / count(*), 6) AS mean_cost, round(CAST(sum(l) AS DOUBLE) / count(*), 6) AS mean_latency
    FROM (SELECT {STRATEGY} AS strategy, CAST(value AS DECIMAL(12,2)) AS v, event_id % 97 AS l,
            time_bucket(INTERVAL {slide_h} HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL {slide_h} HOUR AS w
          FROM events CROSS JOIN (VALUES {offsets}) t(o) WHERE event_type NOT IN ('signup', 'click', 'view', 'error'))
    GROUP BY ALL"""


def event_kind():
    return (F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("click", "view"), "sql_token")
            .when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "error").otherwise("retry")).otherwise("done"))


def metrics(wh, label, size, slide=None):
    rows = event_stream(wh).select("ts", event_kind().alias("kind"), F.expr(STRATEGY).alias("strategy"),
                                   F.col("value").cast("decimal(12,2)").alias("cost"), (F.col("event_id") % 97).alias("latency"))
    stream = streams.windowed_metrics(rows, "ts", "strategy", "cost", "latency", "2 hours", size, slide)
    out = streams.drain_updates(stream, label, ["window_start", "strategy"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "strategy", "n",
                      F.round("mean_cost", 6).alias("mean_cost"), F.round("mean_latency", 6).alias("mean_latency"))


@query("stream_run_metrics", o_windows(6, 6))
def q_stream_run_metrics(wh):
    return metrics(wh, "tumbling", "6 hours")


@query("stream_run_metrics_sliding", o_windows(12, 4))
def q_stream_run_metrics_sliding(wh):
    return metrics(wh, "sliding", "12 hours", "4 hours")


@query("stream_fold_events", f"""
WITH e AS (SELECT *, CASE WHEN lag(ts) OVER p IS NULL OR ts >= lag(ts) OVER p + INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM ({plain(STREAM)}) WINDOW p AS (PARTITION BY request_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY request_id ORDER BY ts, event_id) AS burst FROM e)
SELECT request_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n_events, arg_max(kind, (ts, event_id)) AS last_kind,
  coalesce(string_agg(content, '' ORDER BY ts, event_id) FILTER (WHERE kind = 'sql_token'), '') AS sql_text
FROM s GROUP BY request_id, burst HAVING max(ts) + INTERVAL 3 HOUR <= {CLOSED}""")
def q_stream_fold_events(wh):
    content = F.when(F.col("event_type").isin("click", "view"), F.format_string("tok%d ", "event_id"))
    rows = event_stream(wh).select(F.col("user_id").alias("request_id"), "ts", "event_id", event_kind().alias("kind"), content.alias("content"))
    out = streams.drain_to_table(streams.session_fold(rows, "request_id", "ts", "event_id", "3 hours", "2 hours"), "bursts")
    return out.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


BENCH = "SELECT item_id AS qid, text FROM benchmark"


@query("stream_topk", f"WITH {o_dense(BENCH, DOCS, 3, 'qid', 'doc_id')} SELECT * FROM dense")
def q_stream_topk(wh):
    asked = streams.table_stream(wh.spark, wh.root, "benchmark").select(F.col("item_id").alias("qid"), "text")
    # The static side is an index: vectors are computed once, not once per micro-batch.
    static = materialize(hash_embed(wh.spread("documents").select("doc_id", "text")).drop("text"), "vectors")
    return streams.drain_batches(asked, "nearest", lambda batch: retrieval.topk_dense(
        hash_embed(batch), static, 3, "qid", "doc_id", q_out="qid", i_out="doc_id"))
