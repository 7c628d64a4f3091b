"""Exact top-k joins: the k best items for every query under a scoring kernel.

Spark partitions the work; a kernel scores one bounded block of queries against one bounded block of items with
NumPy inside a task. Three placements, chosen by measured size, give identical results:

* items fit the broadcast bound and are the smaller side -> every query batch is scored against them in place; no shuffle at all
* queries fit the broadcast bound (always used for a short list) -> every item partition keeps its local top-k per query; only those rows shuffle
* neither fits                    -> the caller's ``far`` join, which knows how its scores can be bounded (``pivots`` for cosine)
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.operators.relational import MAX_BROADCAST_ROWS, rows_within, top_per_group

SCORE_DIGITS = 6
FEW_QUERIES = 2_000
BLOCK_ROWS = 2_048
# Cells of one score matrix held in memory at a time.
MATRIX_CELLS = 4_000_000


@dataclass(frozen=True)
class Side:
    """One join side: a table, its id column, and the payload columns the kernel reads."""

    df: DataFrame
    key: str
    payload: tuple[str, ...]

    def narrow(self, prefix: str) -> DataFrame:
        return self.df.select(F.col(self.key).alias(f"{prefix}_id"),
                              *[F.col(c).alias(f"{prefix}_{i}") for i, c in enumerate(self.payload)])


Kernel = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]  # (queries, items) -> scores[n_items, n_queries]
Far = Callable[[Side, Side, Kernel, int, "int | None"], DataFrame]


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per column, row positions of the k best non-NaN scores, best first; ties go to the smaller id."""
    # Text ids are ordered by code point, as the engine orders them.
    ids = ids.astype(str) if ids.dtype == object else ids
    s = np.where(np.isnan(scores), -np.inf, scores).T
    keep = s > -np.inf
    if s.shape[1] > k:
        # Everything at or above the k-th best score stays a candidate, so ties at the cut are settled by id below.
        keep &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    col, row = np.nonzero(keep)
    order = np.lexsort((ids[row], -s[col, row], col))
    col, row = col[order], row[order]
    first = np.searchsorted(col, col, side="left")
    top = np.arange(len(col)) - first < k
    return row[top], col[top]


def _score_blocks(kernel: Kernel, queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top-k of one query block over one item frame, walking the items in slices of bounded matrix size."""
    held: pd.DataFrame | None = None
    step = max(1, MATRIX_CELLS // max(1, len(queries)))
    qid = queries["q_id"].to_numpy()
    for at in range(0, len(items), step):
        part = items.iloc[at:at + step]
        scores = np.round(kernel(queries, part), SCORE_DIGITS) + 0.0
        ids = part["i_id"].to_numpy()
        r, c = best_rows(scores, ids, k)
        held = merge_best(held, pd.DataFrame({"q_id": qid[c], "i_id": ids[r], "score": scores[r, c]}), k)
    return held if held is not None else pd.DataFrame({"q_id": qid[:0], "i_id": qid[:0], "score": np.zeros(0)})


def merge_best(held: pd.DataFrame | None, more: pd.DataFrame, k: int) -> pd.DataFrame:
    if held is None:
        return more
    both = pd.concat([held, more], ignore_index=True)
    both = both.sort_values(["q_id", "score", "i_id"], ascending=[True, False, True], kind="stable")
    return both[both.groupby("q_id", sort=False).cumcount() < k]


def _fetch(side: Side, prefix: str) -> pd.DataFrame:
    return side.narrow(prefix).toPandas()


def _ipc(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def _frame(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_pandas()


def topk_join(queries: Side, items: Side, kernel: Kernel, k: int, *, q_out: str = "query_id", i_out: str = "item_id",
              max_rows: int = MAX_BROADCAST_ROWS, lanes: int | None = None, far: Far | None = None) -> DataFrame:
    """``(q_out, rank, i_out, score)``: descending score rounded to six digits, ties by item id.

    ``far(queries, items, kernel, k, lanes)`` gives at least the k best ``q_id, i_id, score`` where neither side is small.
    """
    q_type = queries.df.schema[queries.key].dataType
    i_type = items.df.schema[items.key].dataType
    schema = T.StructType([T.StructField("q_id", q_type), T.StructField("i_id", i_type),
                           T.StructField("score", T.DoubleType())])

    n_queries = rows_within(queries.narrow("q"), max_rows)
    # A short query list is sent out whatever the items are; probing them would only cost a scan.
    short = n_queries is not None and n_queries <= FEW_QUERIES
    n_items = None if short else rows_within(items.narrow("i"), max_rows if n_queries is None else n_queries)
    if n_items is not None:
        pool = _fetch(items, "i")

        def against_pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, MATRIX_CELLS // max(1, len(pool)))
            for pdf in batches:
                for at in range(0, len(pdf), step):
                    best = _score_blocks(kernel, pdf.iloc[at:at + step], pool, k)
                    yield best.assign(rank=best.groupby("q_id", sort=False).cumcount() + 1)

        placed = queries.narrow("q").mapInPandas(
            against_pool, T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
        return _named(placed, q_out, i_out)
    elif n_queries is not None:
        asked = _fetch(queries, "q")

        def against_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for pdf in batches:
                held = merge_best(held, _score_blocks(kernel, asked, pdf, k), k)
            if held is not None:
                yield held

        local = items.narrow("i").mapInPandas(against_queries, schema)
    else:
        local = far(queries, items, kernel, k, lanes)

    return ranked(local, k, q_out, i_out)


def ranked(hits: DataFrame, k: int, q_out: str, i_out: str) -> DataFrame:
    """The k best of ``q_id, i_id, score`` per query, with their rank."""
    return _named(top_per_group(hits, ["q_id"], [F.desc("score"), F.col("i_id")], k), q_out, i_out)


def _named(placed: DataFrame, q_out: str, i_out: str) -> DataFrame:
    return placed.select(F.col("q_id").alias(q_out), F.col("rank").cast("int"), F.col("i_id").alias(i_out), "score")
