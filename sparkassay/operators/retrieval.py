"""Retrieval: dense, sparse, keyword and fused top-k, approximate neighbours, and context rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.text import tokens
from sparkassay.operators import cells, postings
from sparkassay.operators.features import term_counts
from sparkassay.operators.relational import MAX_BROADCAST_ROWS, top_per_group
from sparkassay.operators.pivots import PivotSearch, item_blocks, place_items
from sparkassay.operators.topk import Kernel, Side, ranked, topk_join
from sparkassay.session import materialize

RRF_K = 60
# Sentence and line format of a rendered context.
NO_CONTEXT = "No relevant context found."
CONTEXT_FORMAT = "[%d] (source: %s, score: %s)\n%s"


def _matrix(column: pd.Series) -> np.ndarray:
    """One row per vector; a null vector is a row of NaN, so that it scores as no candidate."""
    if not column.isna().any():
        return np.array(column.tolist(), dtype=float).reshape(len(column), -1 if len(column) else 1)
    width = max((len(v) for v in column if v is not None), default=1)
    return np.array([np.full(width, np.nan) if v is None else v for v in column], dtype=float).reshape(len(column), width)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def cosine_kernel(q: pd.DataFrame, i: pd.DataFrame) -> np.ndarray:
    items, queries = _matrix(i["i_0"]), _matrix(q["q_0"])
    if items.shape[1] != queries.shape[1]:
        return np.full((len(items), len(queries)), np.nan)
    scores = _unit(items) @ _unit(queries).T
    for side, axis in ((items, 0), (queries, 1)):
        lost = np.isnan(side).any(axis=1)
        if lost.any():
            scores[(lost, slice(None)) if axis == 0 else (slice(None), lost)] = np.nan
    return scores


def cosine_unless_same_text(q: pd.DataFrame, i: pd.DataFrame) -> np.ndarray:
    """Cosine with pairs of identical text (second payload column) removed."""
    scores = cosine_kernel(q, i)
    codes = pd.factorize(pd.concat([i["i_1"], q["q_1"]], ignore_index=True))[0]
    scores[codes[:len(i)][:, None] == codes[len(i):][None, :]] = np.nan
    return scores


def _far(queries: Side, items: Side, kernel: Kernel, k: int, lanes: int | None) -> DataFrame:
    return PivotSearch(queries, items, kernel, k, lanes).hits()


def topk_dense(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, vector: str = "embedding",
               **options) -> DataFrame:
    """k nearest items by cosine. Both sides carry a dense vector column; ``lanes`` sets the number of pivots if given."""
    return topk_join(Side(queries, q_id, (vector,)), Side(items, i_id, (vector,)),
                     cosine_kernel, k, far=_far, **options)


def topk_dense_excluding(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, text: str,
                         vector: str = "embedding", **options) -> DataFrame:
    """As ``topk_dense`` but an item with the query's exact text is never returned. Texts are compared by digest, so their length moves nowhere."""
    digest = lambda df: df.select("*", F.sha2(F.col(text), 256).alias("_same"))
    return topk_join(Side(digest(queries), q_id, (vector, "_same")), Side(digest(items), i_id, (vector, "_same")),
                     cosine_unless_same_text, k, far=_far, **options)


def query_terms(queries: DataFrame, q_id: str, text: str) -> DataFrame:
    """``q, term, tf``: the distinct tokens of every query and how often they occur in it."""
    counted = F.filter(term_counts(tokens(text)), lambda c: c["term"].isNotNull())
    return queries.select(F.col(q_id).alias("q"), F.inline(counted))


def _counted(items: DataFrame, i_id: str, text: str) -> DataFrame:
    """``item, terms, weights, length``, stored: distinct tokens, their counts, and the number of all tokens."""
    rows = items.select(F.col(i_id).alias("item"), tokens(text).alias("_t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            size = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            owner = np.repeat(np.arange(len(words)), size)
            key, n = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            at = pa.array(np.searchsorted(key, np.arange(len(words) + 1) * width), pa.int32())
            terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(key % width)), mask=words.is_null())
            weights = pa.ListArray.from_arrays(at, pa.array(n.astype(float)), mask=words.is_null())
            yield pa.record_batch([batch.column(0), terms, weights, pa.array(size, pa.int32())], names=["item", "terms", "weights", "length"])

    kind = rows.schema["item"].dataType.simpleString()
    return materialize(rows.mapInArrow(count, f"item {kind}, terms array<string>, weights array<double>, length int"), "counted")


def topk_sparse_dot(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, text: str = "text", *,
                    q_out: str = "query_id", i_out: str = "item_id", max_rows: int = MAX_BROADCAST_ROWS, lanes: int | None = None) -> DataFrame:
    """k items with the largest sparse dot product of term counts; items sharing no term are not returned.

    Ids of items are unique. ``max_rows`` bounds broadcast sides; ``lanes`` belongs to the dense join and is not used.
    """
    index = postings.build(_counted(items, i_id, text))
    asked = query_terms(queries, q_id, text).select("q", "term", F.col("tf").cast("double").alias("w"))
    return postings.search(asked, index, k, q_out, i_out, max_rows=max_rows)


def topk_sparse_weights(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, terms: str = "terms",
                        weights: str = "weights", *, q_out: str = "query_id", i_out: str = "item_id",
                        max_rows: int = MAX_BROADCAST_ROWS, lanes: int | None = None) -> DataFrame:
    """As above for supplied sparse vectors in parallel list columns. Weights under zero are read without bounds."""
    pairs = lambda df: F.filter(F.arrays_zip(F.col(terms).alias("term"), F.col(weights).alias("w")), lambda p: p["term"].isNotNull())
    forward = materialize(items.select(F.col(i_id).alias("item"), pairs(items).alias("_p")).select(
        "item", F.col("_p.term").alias("terms"), F.transform("_p.w", lambda w: w.cast("double")).alias("weights")), "supplied")
    asked = materialize(queries.select(F.col(q_id).alias("q"), F.inline(pairs(queries))).groupBy("q", "term").agg(
        F.sum(F.col("w").cast("double")).alias("w")), "asked")
    low = lambda df, c: df.agg(F.min(c)).first()[0]
    least = [low(asked, F.col("w")), low(forward, F.array_min("weights"))]
    return postings.search(asked, postings.build(forward), k, q_out, i_out, prune=all(x is None or x >= 0 for x in least), max_rows=max_rows)


def bm25_index(items: DataFrame, i_id: str, text: str = "text", k1: float = 1.2, b: float = 0.75) -> tuple[postings.Postings, int]:
    """The index of saturated term counts, and the number of items; texts are tokenised once."""
    counted = _counted(items, i_id, text)
    n, avg_len = counted.agg(F.count("*"), F.avg("length")).first()
    norm = k1 * (1 - b + b * F.col("length") / F.lit(float(avg_len or 1.0)))
    forward = counted.select("item", "terms", F.transform("weights", lambda tf: tf * (k1 + 1) / (tf + norm)).alias("weights"))
    return postings.build(forward), n


def bm25_asked(queries: DataFrame, q_id: str, index: postings.Postings, n: int, text: str = "text") -> DataFrame:
    """Distinct query terms with their inverse document frequency."""
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return query_terms(queries, q_id, text).join(index.lexicon.select("term", "df"), "term").select("q", "term", idf.alias("w"))


def topk_bm25(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, text: str = "text",
              k1: float = 1.2, b: float = 0.75, *, q_out: str = "query_id", i_out: str = "item_id",
              max_rows: int = MAX_BROADCAST_ROWS, lanes: int | None = None) -> DataFrame:
    """Keyword ranking through the index; arguments as for ``topk_sparse_dot``."""
    index, n = bm25_index(items, i_id, text, k1, b)
    return postings.search(bm25_asked(queries, q_id, index, n, text), index, k, q_out, i_out, max_rows=max_rows)


def rrf(lists: list[DataFrame], k_out: int, q_id: str = "query_id", i_id: str = "item_id", rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists that were each cut to their own top-k before."""
    merged = lists[0].select(q_id, i_id, "rank")
    for other in lists[1:]:
        merged = merged.unionByName(other.select(q_id, i_id, "rank"))
    fused = (merged.groupBy(q_id, i_id)
             .agg(F.round(F.sum(F.lit(1.0).cast("double") / (F.lit(rrf_k) + F.col("rank"))), 6).alias("score")))
    return top_per_group(fused, [q_id], [F.desc("score"), F.col(i_id)], k_out).select(q_id, "rank", i_id, "score")


def topk_hybrid(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, text: str = "text",
                vector: str = "embedding", rrf_k: int = RRF_K, **options) -> DataFrame:
    dense = topk_dense(queries, items, k, q_id, i_id, vector, **options)
    sparse = topk_sparse_dot(queries, items, k, q_id, i_id, text, **options)
    return rrf([dense, sparse], k, options.get("q_out", "query_id"), options.get("i_out", "item_id"), rrf_k)


# The prompt strategies, and the retrieval type of those that look a schema up.
STRATEGIES = ("zero_shot", "few_shot_static", "few_shot_dynamic", "chain_of_thought", "rag_dense", "rag_sparse",
              "rag_hybrid", "dspy", "routed", "tool_use", "rag")
RETRIEVAL_OF = {"rag": "dense", "rag_dense": "dense", "rag_sparse": "sparse", "rag_hybrid": "hybrid", "dspy": "hybrid"}


def retrieve(queries: DataFrame, items: DataFrame, how: str, k: int, q_id: str, i_id: str, text: str = "text",
             vector: str = "embedding", **options) -> DataFrame:
    """Dispatch by retrieval type, or by the name of a strategy that retrieves."""
    how = RETRIEVAL_OF.get(how, how)
    if how == "dense":
        return topk_dense(queries, items, k, q_id, i_id, vector, **options)
    if how == "sparse":
        return topk_sparse_dot(queries, items, k, q_id, i_id, text, **options)
    if how == "hybrid":
        return topk_hybrid(queries, items, k, q_id, i_id, text, vector, **options)
    raise ValueError(f"unknown retrieval type {how!r}")


def topk_ann(queries: DataFrame, items: DataFrame, k: int, q_id: str, i_id: str, dim: int, vector: str = "embedding",
             target: float = 0.94, seed: int = 7, q_out: str = "query_id", i_out: str = "item_id") -> DataFrame:
    """Approximate neighbours: the items of the cells nearest to a query, ranked by exact cosine.

    Centres are fitted on a bounded sample of the items, and a query visits as many cells as sampled items need to find
    ``target`` of their own neighbours. A query moves once to each region of cells, however many of them it visits.
    Null vectors on either side have no neighbours.
    """
    asked, held = Side(queries, q_id, (vector,)), Side(items, i_id, (vector,))
    model = cells.fit(held, k, target, seed)
    placed = (model.centres, item_blocks(place_items(held, model.centres), cells.CELL_ROWS, cells.BLOCK_ROWS)) if model else (None, None)
    search = PivotSearch(asked, held, cosine_kernel, k, placed=placed)
    return ranked(search.near_hits(model.probes if model else 1), k, q_out, i_out)


def context_block(queries: DataFrame, q_id: str, hits: DataFrame, source: Column, text: str = "text") -> DataFrame:
    """Numbered, source-tagged passages per query (at most k of them), or a fixed sentence when there are none."""
    two_digits = F.round(F.col("score").cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string")
    entry = F.format_string(CONTEXT_FORMAT, F.col("rank"), F.coalesce(source, F.lit("unknown")), two_digits,
                            F.col(text))
    blocks = (hits.select(F.col(q_id).alias("_q"), F.struct("rank", entry.alias("e")).alias("s"))
              .groupBy("_q").agg(F.sort_array(F.collect_list("s")).alias("s")))
    return (queries.select(q_id).join(blocks, F.col(q_id) == F.col("_q"), "left")
            .select(q_id, F.coalesce(F.array_join(F.col("s.e"), "\n\n"), F.lit(NO_CONTEXT)).alias("context")))
