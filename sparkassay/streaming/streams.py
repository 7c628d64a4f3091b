"""Structured Streaming forms of the screening, routing, metric and retrieval operators.

Sinks are Parquet tables in the shared folder, never the driver. Each stream runs with ``availableNow``: it drains
what is there, then stops, and can be started again on the same checkpoint to pick up new files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions.difficulty import rule_grade
from sparkassay.functions.screening import check_input
from sparkassay.session import scratch_path


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<name>.parquet`` as a stream with the table's own schema.

    The path is written as a glob, which a file stream accepts whether the table is one file or a folder of files.
    """
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{root}/{name}[.]parquet")


def drain_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream to its current end and return the table it wrote."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, label: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``step`` on every micro-batch; a repeated batch overwrites its own folder, so retries do not double."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def screen_and_grade(questions: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Stateless: input verdict, and a difficulty for the texts that pass."""
    verdict, grade = check_input(text), rule_grade(F.col(text))
    return (questions.select(*keys, verdict.alias("v"), grade.alias("g"))
            .select(*keys, "v.passed", "v.category", F.when(F.col("v.passed"), F.col("g.difficulty")).alias("difficulty")))


def drain_updates(stream: DataFrame, label: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run an update-mode aggregate to its current end and return its table: the newest row of every key, open windows too.

    Every micro-batch writes the rows it changed to a folder of its own, which a repeated batch overwrites, and readers
    take the row of the largest batch. So an update never rewrites older rows and a retry changes nothing. A later call with
    the same ``folder`` goes on from where the last one stopped.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)
    out, state = f"{folder}/table", f"{folder}/state"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    versions = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return newest(spark.read.schema(versions).parquet(out), keys)


def newest(versions: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    """The row of the largest version of every key; a combinable maximum, not a window."""
    rest = [c for c in versions.columns if c not in (*keys, version)]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def windowed_metrics(events: DataFrame, at: str, by: str, cost: str, latency: str, delay: str, size: str,
                     slide: str | None = None, kind: str = "kind") -> DataFrame:
    """Finished runs, mean cost and mean latency per event-time window and ``by``.

    Only ``done`` events count; rows later than ``delay`` are dropped by the watermark, which also bounds the state.
    """
    window = F.window(at, size, slide) if slide else F.window(at, size)
    # Decimals are summed exactly before they are divided.
    mean = lambda c: F.try_divide(F.sum(c).cast("double"), F.count(c))
    return (events.filter(F.col(kind) == "done").withWatermark(at, delay).groupBy(window.alias("_w"), by)
            .agg(F.count("*").alias("n"), mean(cost).alias("mean_cost"), mean(latency).alias("mean_latency"))
            .select(F.col("_w.start").alias("window_start"), by, "n", "mean_cost", "mean_latency"))


def session_fold(events: DataFrame, request: str, at: str, order: str, gap: str, delay: str) -> DataFrame:
    """Rebuild each request's text per burst of activity; a burst closes after ``gap`` without events.

    State per burst is the burst itself, which the gap bounds in time.
    """
    token = F.when(F.col("kind") == "sql_token", F.struct(at, order, "content"))
    last = F.max(F.struct(at, order, "kind"))["kind"]
    return (events.withWatermark(at, delay).groupBy(request, F.session_window(at, gap).alias("_w"))
            .agg(F.count("*").alias("n_events"), F.sort_array(F.collect_list(token)).alias("_t"), last.alias("last_kind"))
            .select(request, F.col("_w.start").alias("started"), "n_events", "last_kind",
                    F.array_join(F.transform("_t", lambda t: t["content"]), "").alias("sql_text")))
