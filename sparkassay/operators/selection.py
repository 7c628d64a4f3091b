"""Example selection and difficulty routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.difficulty import LEVELS, with_rule_grade
from sparkassay.functions.vectors import hash_vector
from sparkassay.operators.relational import broadcast_if_small, top_per_group
from sparkassay.operators.retrieval import topk_dense, topk_dense_excluding
from sparkassay.session import materialize

CONFIDENCE_FLOOR = 0.30
DEFAULT_MODEL = "openai/gpt-4o-mini"
# Prompt strategy per difficulty.
STRATEGY_OF = {"easy": "zero_shot", "medium": "few_shot_dynamic", "hard": "few_shot_dynamic"}


def level_rank(level: Column | str, levels: list[str] = LEVELS) -> Column:
    return F.array_position(F.lit(levels), level)


def fewshot_static(pool: DataFrame, pos: str, n: int = 3, difficulty: str = "difficulty") -> DataFrame:
    """The first example of every difficulty, easy to hard, at most n. One combinable aggregate, no window."""
    rest = [c for c in pool.columns if c != difficulty]
    first = pool.filter(F.col(difficulty).isin(LEVELS)).groupBy(difficulty).agg(
        F.min_by(F.struct(*rest), F.col(pos)).alias("_e"))
    return first.orderBy(level_rank(F.col(difficulty))).limit(n).select(difficulty, "_e.*")


def fewshot_dynamic(questions: DataFrame, pool: DataFrame, q_id: str, ex_id: str, text: str = "text", n: int = 3,
                    vector: str = "embedding", **options) -> DataFrame:
    """n nearest pool examples per question, never one with the question's own text."""
    return topk_dense_excluding(questions, pool, n, q_id, ex_id, text, vector, **options)


def classify_knn(questions: DataFrame, pool: DataFrame, q_id: str, ex_id: str, label: str, k: int = 5,
                 vector: str = "embedding", tie: Column | None = None, **options) -> DataFrame:
    """Majority label of the k nearest pool rows; confidence is votes / k. Ties go to the smaller ``tie`` value."""
    hits = topk_dense(questions, pool, k, q_id, ex_id, vector, q_out="_q", i_out="_ex", **options)
    labels = broadcast_if_small(pool.select(F.col(ex_id).alias("_ex"), F.col(label).alias("_label")))
    votes = (hits.join(labels, "_ex")
             .groupBy("_q", "_label").agg(F.count("*").alias("_votes")))
    order = [F.desc("_votes"), tie if tie is not None else F.col("_label")]
    best = top_per_group(votes, ["_q"], order, 1)
    return best.select(F.col("_q").alias(q_id), F.col("_label").alias(label),
                       F.bround(F.col("_votes") / F.lit(float(k)), 3).alias("confidence"))


def routing_table(spark, default_model: str = DEFAULT_MODEL, hard_model: str | None = None) -> DataFrame:
    rows = [(lv, hard_model or default_model if lv == "hard" else default_model, STRATEGY_OF[lv]) for lv in LEVELS]
    return spark.createDataFrame(rows, "difficulty string, model string, strategy string")


def with_route(df: DataFrame, **models) -> DataFrame:
    """Attach model and strategy from the three-row routing table."""
    return df.join(F.broadcast(routing_table(df.sparkSession, **models)), "difficulty")


def route(questions: DataFrame, pool: DataFrame, q_id: str, ex_id: str, k: int = 5, question: str = "question",
          dim: int = 64, floor: float = CONFIDENCE_FLOOR, **models) -> DataFrame:
    """Rules first; only questions under the confidence floor are embedded and put to the neighbour vote."""
    graded = with_rule_grade(questions.select(q_id, question), question)
    sure = graded.filter(F.col("confidence") >= floor).select(
        q_id, "difficulty", "confidence", F.lit("rule_based").alias("method"))
    unsure = graded.filter(F.col("confidence") < floor).select(
        q_id, hash_vector(question, dim).alias("embedding"))
    # Vectors are read more than once; the tasks that read them do not make them.
    unsure, pool = materialize(unsure, "unsure"), materialize(pool.select(ex_id, "difficulty", "embedding"), "pool")
    voted = classify_knn(unsure, pool, q_id, ex_id, "difficulty", k, tie=level_rank(F.col("_label")))
    return with_route(sure.unionByName(voted.withColumn("method", F.lit("embedding"))), **models)


def select_demos(attempts: DataFrame, run: str, pos: str, score: str, failed: str, size: int = 4,
                 max_errors: int = 3) -> DataFrame:
    """Demonstrations per run: attempts scoring 1 in training order, filled up with labelled examples.

    The search gives up at the ``max_errors``-th failed call. Both cuts are ranked group limits, so a run holding
    most of the rows still sends only a handful of them through its final task.
    """
    stop = (top_per_group(attempts.filter(F.col(failed)).select(run, pos), [run], [F.col(pos)], max_errors, "_n")
            .filter(F.col("_n") == max_errors).select(F.col(run).alias("_run"), F.col(pos).alias("_stop")))
    passing = (attempts.filter((F.col(score) == 1) & ~F.col(failed))
               .join(broadcast_if_small(stop), F.col(run) == F.col("_run"), "left")
               .filter(F.col("_stop").isNull() | (F.col(pos) < F.col("_stop"))).select(run, pos))
    found = top_per_group(passing, [run], [F.col(pos)], size).withColumn("kind", F.lit("bootstrapped"))
    # At most ``size`` early rows per run can be needed as fill beyond those already chosen.
    early = (top_per_group(attempts.select(run, pos), [run], [F.col(pos)], 2 * size, "_n").drop("_n")
             .join(found.select(run, pos), [run, pos], "left_anti").withColumn("kind", F.lit("labelled")))
    both = found.drop("rank").unionByName(early)
    return top_per_group(both, [run], [F.col("kind"), F.col(pos)], size).select(run, "rank", pos, "kind")
