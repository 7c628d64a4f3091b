"""The far join sends a query once to each region of items, however many cells of it the query meets."""

import numpy as np

from sparkassay.operators import pivots, retrieval
from sparkassay.operators.topk import Side, _frame


def rows(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<double>")


def test_queries_move_once_per_region_and_all_cells_are_met(spark, monkeypatch):
    monkeypatch.setattr(pivots, "REGION_ROWS", 400)
    monkeypatch.setattr(pivots, "QUERY_ROWS", 64)
    rng = np.random.default_rng(3)
    # No structure: every query meets nearly every cell. Two thirds of the items are one vector, a cell larger than a region.
    items, queries = rng.normal(size=(900, 8)), rng.normal(size=(150, 8))
    items[:600] = items[0]
    search = pivots.PivotSearch(Side(rows(spark, queries, "q"), "q", ("embedding",)), Side(rows(spark, items, "i"), "i", ("embedding",)),
                                retrieval.cosine_kernel, 3, 30)
    sent = sum(len(_frame(bytes(r.q_block))) for r in search.visits().collect())
    assert sent <= 150 * search.n_regions and search.n_regions < len(search.cells)
    got = retrieval.topk_dense(rows(spark, queries, "q"), rows(spark, items, "i"), 3, "q", "i", max_rows=0, lanes=30)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(items).T, 6)
    want = [(q, r + 1, int(i), float(scores[q, i])) for q in range(150)
            for r, i in enumerate(np.lexsort((np.arange(900), -scores[q]))[:3])]
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == want
