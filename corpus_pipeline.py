"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data and packing, over all documents.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; ``run`` stores every stage's
rows as Parquet in the shared folder and gives the stored rows to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import decontam, jaccard, langid, packing, pii
from sparkassay.llm.queries import VOCABULARY
from sparkassay.session import materialize

#: Cosine with the best prototype under which a text of at least so many characters is like no known language.
LOW_SCORE, SHORT_TEXT = 0.1, 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; null texts, texts without letters and texts like no known language are rejected.

    Prototypes are learned from the labelled documents; a document keeps its own ``lang``. A text of ``SHORT_TEXT``
    characters or more is like no known language if its cosine with every prototype is under ``LOW_SCORE``; the cosine
    of a shorter text says too little. Without prototypes every text with letters stays.
    """
    model = langid.learn(docs)
    if not model:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    named = langid.identify(docs, model, lang_out="__lang", score_out="__score")
    told = (F.col("__score") >= LOW_SCORE) | (F.length("text") < SHORT_TEXT)
    return named.filter((F.col("__lang") != langid.UNDETERMINED) & told).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: the one with the smallest id; documents without an id stay.

    A link is a pair of five-word Jaccard similarity of at least 0.8. Rows that share an id are told apart by their texts.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.clean(docs, benchmark)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by the kind's name; ``n_chars`` follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, ids included, with the training sequence and offset each is packed at."""
    return packing.pack(docs, VOCABULARY, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Learned prototypes, a tokenizer and the edit search cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
