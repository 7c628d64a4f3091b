"""Feature tables: distinct-text embedding through a supplied model, hashed vectors, sparse term weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.text import tokens
from sparkassay.functions.vectors import hash_vector
from sparkassay.operators.skew import salted_join

Embedder = Callable[[list[str]], list[list[float]]]


def embed_distinct(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """Call ``embedder`` once per distinct text (in Arrow batches) and attach the vector to every row.

    The distinct step pre-aggregates before its shuffle and the join back salts texts that repeat very often.
    """
    counts = df.groupBy(text).agg(F.count("*").alias("_n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({text: pdf[text], "_n": pdf["_n"], out: embedder(pdf[text].tolist())})

    vectors = counts.mapInPandas(run, f"`{text}` string, _n long, `{out}` array<double>")
    return salted_join(df, vectors, text, counts, "_n").drop("_n")


def hash_embed(df: DataFrame, text: str = "text", dim: int = 64, out: str = "embedding") -> DataFrame:
    return df.withColumn(out, hash_vector(text, dim))


def vector_entries(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Non-zero vector entries as ``(key, bucket, weight)`` rows."""
    # The outer form keeps the optimizer from computing the vector a second time for an inferred size filter.
    return df.select(key, F.posexplode_outer(vector).alias("bucket", "weight")).filter(F.col("weight") != 0)


def sparse_from_lists(df: DataFrame, key: str, indices: str, values: str) -> DataFrame:
    """Supplied parallel index and value lists as ``(key, term, weight)`` rows."""
    pairs = F.arrays_zip(F.col(indices).alias("term"), F.col(values).alias("weight"))
    return df.select(key, F.explode(pairs).alias("_p")).select(key, "_p.term", "_p.weight")


def term_counts(tokens_of: Column) -> Column:
    """Distinct tokens of a token list with their counts, ``array<struct<term, tf>>`` in term order; null for a null list.

    Counted inside the row as runs of its sorted tokens, so postings are produced without a shuffle. The sorted
    list and the run starts are lambda variables, computed once per row.
    """

    def starts(s):
        at = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
        return F.struct(s.alias("s"), F.filter(at, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))).alias("f"))

    def runs(r):
        ends = F.concat(F.slice(r["f"], F.lit(2), F.size(r["f"])), F.array(F.size(r["s"])))
        return F.zip_with(r["f"], ends, lambda a, b: F.struct(F.get(r["s"], a).alias("term"), (b - a).cast("bigint").alias("tf")))

    return F.transform(F.transform(F.array(F.sort_array(tokens_of)), starts), runs)[0]


def sparse_terms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Term counts per row: ``(key, term, tf)``."""
    return df.select(key, F.inline(term_counts(tokens(text)))).filter(F.col("term").isNotNull())
