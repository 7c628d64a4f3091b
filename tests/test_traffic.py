"""What moves, and how long one task works, does not grow faster than it must."""

import numpy as np

from sparkassay.operators import cells, pivots, retrieval
from sparkassay.operators.topk import Side
from sparkassay.sources.tables import Warehouse


def frame(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<double>")


def kept_visits(monkeypatch):
    found = []
    plain = pivots.PivotSearch._visits
    monkeypatch.setattr(pivots.PivotSearch, "_visits", lambda self, *a: found.append((self, plain(self, *a))) or found[-1][1])
    return found


def test_approximate_search_moves_a_query_once_per_region(spark, monkeypatch):
    found = kept_visits(monkeypatch)
    m = np.random.default_rng(4).normal(size=(1500, 16))
    model = cells.fit(Side(frame(spark, m, "i"), "i", ("embedding",)), 5, 0.94, 7)
    near = retrieval.topk_ann(frame(spark, m[:200], "q"), frame(spark, m, "i"), 5, "q", "i", dim=16)
    got = {(r.query_id, r.item_id) for r in near.collect()}
    (search, visits), = found
    assert model.probes > 2 * search.n_regions
    assert visits.groupBy().sum("n").first()[0] <= 200 * search.n_regions
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(200) for i in np.argsort(-np.round(unit[q] @ unit.T, 6), kind="stable")[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_blocks_are_repeated_for_the_queries_that_come(spark, monkeypatch):
    found = kept_visits(monkeypatch)
    monkeypatch.setattr(pivots, "QUERY_ROWS", 16)
    rng = np.random.default_rng(5)
    search = pivots.PivotSearch(Side(frame(spark, rng.normal(size=(160, 8)), "q"), "q", ("embedding",)),
                                Side(frame(spark, rng.normal(size=(600, 8)), "i"), "i", ("embedding",)), retrieval.cosine_kernel, 3, 12)
    search.visits()
    # The first meeting needs one task a region; more come with the queries or are asked for.
    splits = lambda v, tasks: sorted(r.splits for r in search._splits(v, tasks).collect())
    first, second = [v for _, v in found]
    assert splits(first, 1) == [1] * search.n_regions
    assert splits(second, 4 * search.n_regions) == [4] * search.n_regions
    monkeypatch.setattr(pivots, "SPLIT_QUERIES", 50)
    assert max(splits(first, 1)) >= 160 // 50


def test_statements_of_a_task_are_bounded(spark, tmp_path):
    n = 1500
    spark.range(n).write.parquet(f"{tmp_path}/orders.parquet")
    wh = Warehouse(spark, str(tmp_path))
    assert wh.spread("orders", 10).rdd.getNumPartitions() >= n // 10 > spark.sparkContext.defaultParallelism
    assert wh.spread("orders", n).rdd.getNumPartitions() == wh.spread("orders").rdd.getNumPartitions()
