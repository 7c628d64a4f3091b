"""What a task holds does not grow with the tables."""

import tracemalloc

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sparkassay.operators import cells, pivots, postings, retrieval, topk
from sparkassay.operators.topk import Side
from sparkassay.session import BLOCK_FILES, materialize


def rows(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<double>")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_angles_of_items_are_held_some_at_a_time():
    rng = np.random.default_rng(1)
    units, centres = unit(rng.normal(size=(4_000, 8))), unit(rng.normal(size=(3_000, 8)))
    tracemalloc.start()
    cell, angle = pivots._nearest(units, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * pivots.ANGLES < 8 * len(units) * len(centres)
    want = np.arccos(np.clip(units @ centres.T, -1, 1))
    assert np.allclose(angle, want.min(axis=1)) and (cell == want.argmin(axis=1)).mean() > 0.999


def test_centres_are_fitted_some_rows_at_a_time(monkeypatch):
    m = unit(np.random.default_rng(2).normal(size=(6_000, 8)))
    whole = cells.centres_of(m, 500, np.random.default_rng(3))
    monkeypatch.setattr(cells, "FIT_SCORES", 100_000)
    tracemalloc.start()
    some = cells.centres_of(m, 500, np.random.default_rng(3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(m) * 500 / 4 and np.allclose(whole, some)


def test_far_join_is_exact_in_small_pieces(spark, monkeypatch):
    """Few angles and scores at a time, single precision first; close scores, ties, zero vectors and text ids included."""
    monkeypatch.setattr(pivots, "ANGLES", 50)
    monkeypatch.setattr(pivots, "SCORES", 200)
    rng = np.random.default_rng(4)
    items, queries = rng.normal(size=(500, 6)), rng.normal(size=(60, 6))
    # Scores that differ in the sixth digit or not at all.
    items[100:200] = items[0] + rng.normal(size=(100, 6)) * 1e-6
    items[200:230], items[240], queries[:20], queries[21] = items[5], 0, items[0], 0
    hits = retrieval.topk_dense(rows(spark, queries, "q"), rows(spark, items, "i").select(F.format_string("%03d", "i").alias("i"), "embedding"),
                                4, "q", "i", max_rows=0, lanes=25)
    with np.errstate(invalid="ignore"):
        scores = np.round(np.nan_to_num(unit(queries)) @ np.nan_to_num(unit(items)).T, 6) + 0.0
    want = [(q, r + 1, f"{i:03d}", float(scores[q, i])) for q in range(60) for r, i in enumerate(np.lexsort((np.arange(500), -scores[q]))[:4])]
    assert [tuple(r) for r in hits.orderBy("query_id", "rank").collect()] == want


def test_files_of_large_rows_have_small_row_groups(spark):
    blob = F.udf(lambda i: np.random.default_rng(i).bytes(1 << 20), "binary")
    big = spark.range(60, numPartitions=1).select("id", blob("id").alias("block"))
    stored = materialize(big, "blocks", BLOCK_FILES)
    assert stored.agg(F.sum(F.octet_length("block"))).first()[0] == 60 << 20
    meta = pq.ParquetFile(next(f.removeprefix("file://") for f in stored.inputFiles())).metadata
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 32 << 20


def test_vectors_of_few_values_are_packed_tight():
    import pandas as pd

    block = pd.DataFrame({"i_id": np.arange(2_048), "i_0": [np.eye(64)[i % 64] for i in range(2_048)]})
    data = topk._ipc(block)
    assert len(data) < 2_048 * 64 * 8 / 10
    again = topk._frame(data)
    assert (again["i_id"] == block["i_id"]).all() and (np.stack(again["i_0"]) == np.stack(block["i_0"])).all()


def test_postings_are_packed_before_they_are_repeated(spark):
    """Blocks hold every row at its place, null ids too, in less than the rows take."""
    some = spark.range(3_000, numPartitions=3).select(
        F.when(F.col("id") % 100 != 7, F.col("id")).alias("item"), F.array(F.lit("price"), F.lit("integer"), F.col("id").cast("string")).alias("terms"),
        F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)).alias("weights"))
    packed = postings._packed(some, F.pmod(F.xxhash64("item"), F.lit(4)).cast("int"), ["item", "terms", "weights"], "_chunk").toArrow()
    found, n_bytes, n_raw = [], 0, 0
    for chunk in range(4):
        mine = packed.filter(np.array(packed.column("_chunk")) == chunk)
        n_bytes, n_raw = n_bytes + sum(len(b.as_buffer()) for b in mine.column("block")), n_raw + postings._unpacked(mine).nbytes
        found += [(chunk, i, tuple(t), tuple(w)) for i, t, w in zip(*[postings._unpacked(mine).column(c).to_pylist() for c in ("item", "terms", "weights")])]
    want = [(r.c, r.item, tuple(r.terms), tuple(r.weights)) for r in some.withColumn("c", F.pmod(F.xxhash64("item"), F.lit(4))).collect()]
    key = lambda r: (r[0], r[2])
    assert sorted(found, key=key) == sorted(want, key=key)
    assert n_bytes < 0.6 * n_raw


def test_excluded_texts_are_compared_by_digest(spark, monkeypatch):
    sides = []
    plain = retrieval.topk_join
    monkeypatch.setattr(retrieval, "topk_join", lambda *sides_, **more: sides.extend(sides_[:2]) or plain(*sides_, **more))
    long = "word " * 5_000
    pool = spark.createDataFrame([(1, long, [1.0, 0.0]), (2, None, [1.0, 0.1]), (3, "c", [1.0, 0.2])], "i long, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, long, [1.0, 0.0]), (2, None, [1.0, 0.0])], "q long, text string, embedding array<double>")
    got = {(r.query_id, r.item_id) for r in retrieval.topk_dense_excluding(asked, pool, 3, "q", "i", "text").collect()}
    assert got == {(1, 2), (1, 3), (2, 1), (2, 3)}
    assert all(len(r.i_1 or "") <= 64 for s in sides for r in s.narrow("i").collect())
