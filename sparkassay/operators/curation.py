"""Building question sets: validate, number, split, combine, format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions.text import is_blank
from sparkassay.operators.prompts import chat_example

TARGET = 50


def validate_candidates(candidates: DataFrame, executions: DataFrame, rows: DataFrame, q: str) -> DataFrame:
    """Candidates with a statement that ran and returned rows, with their row count.

    ``rows`` is the normalised long result; it stays long, and ``expected_rows`` keeps the accepted part of it.
    """
    counts = rows.groupBy(q).agg(F.count("*").alias("n_rows"))
    ran = executions.filter(F.col("error").isNull()).select(q)
    return candidates.filter(~is_blank("sql")).join(ran, q, "left_semi").join(counts, q)


def expected_rows(valid: DataFrame, rows: DataFrame, q: str) -> DataFrame:
    return rows.join(valid.select(q), q, "left_semi")


def assign_ids(valid: DataFrame, order: list[str], target: int = TARGET) -> DataFrame:
    """The first ``target`` accepted rows in arrival order, numbered sq001, sq002, ...

    The target is part of the operator: a distributed top-n keeps that many rows, and only those are numbered.
    """
    first = valid.orderBy(*order).limit(target)
    n = F.row_number().over(Window.orderBy(*order))
    return first.withColumn("id", F.format_string("sq%03d", n))


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split_train_holdout(df: DataFrame, key: str | list[str], train_share: float, seed: int = 42, at_least: int = 0,
                        digits: int = 4) -> DataFrame:
    """Exact share split in a seeded pseudo-random order of a unique key of one or more columns; adds ``split``.

    The order is never materialised. Counts per digest prefix (at most 16 ** digits rows) show which prefix the cut
    falls into; every other row is decided by its prefix alone and only that prefix's rows are ranked.
    """
    keys = [key] if isinstance(key, str) else list(key)
    keyed = df.withColumn("_h", shuffle_key(F.concat_ws(":", *keys), seed)).withColumn("_p", F.substring("_h", 1, digits))
    sizes = keyed.groupBy("_p").agg(F.count("*").alias("_c"))
    running = sizes.select("_p", "_c", F.sum("_c").over(Window.orderBy("_p")).alias("_to"))
    n = running.agg(F.coalesce(F.max("_to"), F.lit(0))).scalar()
    cut = F.greatest(F.lit(at_least).cast("bigint"), F.floor(n * F.lit(train_share)))
    # One small row reaches the driver: the prefix the cut falls into and how many of its rows are train rows.
    edge = (running.filter((F.col("_to") - F.col("_c") <= cut) & (cut < F.col("_to")))
            .select("_p", (cut - F.col("_to") + F.col("_c")).alias("take")).first())
    if edge is None:
        return keyed.withColumn("split", F.lit("train")).drop("_h", "_p")
    on_edge = F.col("_p") == edge["_p"]
    decided = keyed.filter(~on_edge).withColumn(
        "split", F.when(F.col("_p") < edge["_p"], F.lit("train")).otherwise(F.lit("holdout")))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *keys))
    ranked = keyed.filter(on_edge).withColumn(
        "split", F.when(rank <= edge["take"], F.lit("train")).otherwise(F.lit("holdout")))
    return decided.unionByName(ranked).drop("_h", "_p")


def combine_dedup(pairs: DataFrame, source: str = "src", pos: str | list[str] = "pos", question: str = "question",
                  exclude: list[int] | None = None) -> DataFrame:
    """Union of sources with the first occurrence of every question text kept (source order, then position).

    A combinable minimum per text: a question repeated across a third of the rows shrinks to one row per input
    partition before the shuffle.
    """
    if exclude:
        pairs = pairs.filter(~F.col(source).isin(exclude))
    rest = [c for c in pairs.columns if c != question]
    first = pairs.groupBy(question).agg(F.min_by(F.struct(*rest), F.struct(source, *([pos] if isinstance(pos, str) else pos))).alias("_r"))
    return first.select(question, "_r.*")


def format_examples(pairs: DataFrame, schema: str) -> DataFrame:
    return pairs.withColumn("messages", chat_example(schema, F.col("question"), F.col("sql")))


def write_jsonl(df: DataFrame, path: str, split: str = "split") -> None:
    """One JSON object per line, one folder per split."""
    df.write.mode("overwrite").partitionBy(split).json(path)
