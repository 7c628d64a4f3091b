"""Prompts for questions that each name their strategy: one plan in which every step runs once, for the rows that need it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.operators import prompts, selection
from sparkassay.operators.features import hash_embed
from sparkassay.operators.relational import attach
from sparkassay.operators.retrieval import RETRIEVAL_OF, STRATEGIES, retrieve
from sparkassay.session import materialize
from sparkassay.sources.catalog import schema_block

TOP_TABLES, EXAMPLES = 5, 3


@dataclass(frozen=True)
class Steps:
    """Where a strategy's examples (``none``, ``static``, ``dynamic``) and its schema (``full`` or a retrieval type) come from."""

    examples: str = "none"
    schema: str = "full"


STEPS = {s: Steps({"few_shot_static": "static", "few_shot_dynamic": "dynamic"}.get(s, "none"), RETRIEVAL_OF.get(s, "full")) for s in STRATEGIES}


def _needing(questions: DataFrame, step: str, value: str) -> DataFrame:
    return questions.filter(F.col("strategy").isin([s for s, steps in STEPS.items() if getattr(steps, step) == value]))


def prompts_by_strategy(questions: DataFrame, pool: DataFrame, static: DataFrame, definitions: DataFrame, full_schema: str,
                        k: int = TOP_TABLES) -> DataFrame:
    """``qid, strategy, system, user`` for ``questions`` (``qid, text, strategy``).

    ``pool`` (``ex_id, text, sql``) gives dynamic examples, ``static`` (``rank, text, sql``, a handful of rows) the fixed ones,
    ``definitions`` (``pos, text``) the tables to retrieve. A retrieving strategy that finds no table, and an unknown
    strategy, get the full schema without examples.
    """
    asked = materialize(questions.select("qid", "text", "strategy"), "asked")
    # Vectors are read more than once; the tasks that read them do not make them.
    hashed = lambda df, label: materialize(hash_embed(df), label)
    hits = selection.fewshot_dynamic(hashed(_needing(asked, "examples", "dynamic"), "dynamic"), hashed(pool.select("ex_id", "text"), "pool"), "qid", "ex_id",
                                     n=EXAMPLES, q_out="qid", i_out="ex_id")
    dynamic = prompts.ordered_pairs(attach(hits, pool, "ex_id"), "qid", "rank", "text")
    fixed = prompts.ordered_pairs(static.withColumn("_all", F.lit(1)), "_all", "rank", "text").select("pairs").scalar()
    pairs = dynamic.unionByName(_needing(asked, "examples", "static").select("qid", fixed.alias("pairs")))

    items = hashed(definitions, "definitions")
    found = None
    for how in ("dense", "sparse", "hybrid"):
        mine = _needing(asked, "schema", how)
        ranked = retrieve(mine if how == "sparse" else hashed(mine, how), items, how, k, "qid", "pos", q_out="qid", i_out="pos")
        ranked = ranked.select("qid", "rank", "pos")
        found = ranked if found is None else found.unionByName(ranked)
    blocks = schema_block(attach(found, definitions.select("pos", F.col("text").alias("table_def")), "pos"), ["qid"], "rank")

    joined = asked.join(pairs, "qid", "left").join(blocks, "qid", "left")
    shown = prompts.render_prompt(F.col("strategy"), prompts.fewshot_block(F.col("pairs")),
                                  F.coalesce("schema_block", F.lit(full_schema)), F.col("text"))
    return joined.select("qid", "strategy", shown.alias("p")).select("qid", "strategy", "p.*")
