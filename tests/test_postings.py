"""Search over postings: frequent terms are left out first, and a pair that shares a term makes no row."""

from collections import Counter

from sparkassay.operators import postings, retrieval


def test_frequent_terms_are_left_out_first(spark):
    items = spark.createDataFrame([(i, "zebra" + (" apple" if i in (7, 8) else "")) for i in range(300)], "item long, text string")
    index = postings.build(retrieval._counted(items, "item", "text"))
    asked = spark.createDataFrame([(1, "apple", 1.0), (1, "zebra", 1.0)], "q long, term string, w double")
    planned = {r.term: r.room for r in postings.plan(asked, index, 2).collect()}
    assert planned["zebra"] is None and planned["apple"] is not None
    found = postings.search(asked, index, 2, "q", "item").orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(1, 1, 7, 2.0), (1, 2, 8, 2.0)]


def test_chunks_and_groups_give_every_best_item(spark, monkeypatch):
    monkeypatch.setattr(postings, "CHUNK", 100)
    monkeypatch.setattr(postings, "QUERY_GROUP", 5)
    words = ["the", "of", "brand", "red", "blue", "size", "nine", "ten", "oak", "elm"]
    texts = {i: " ".join(words[j % 10] for j in range(i % 7, i % 7 + 1 + (i * 5) % 9)) for i in range(150)}
    asked = {-q: " ".join(words[(q * j) % 10] for j in range(1, 5)) for q in range(1, 13)}
    want = []
    for q, text in asked.items():
        mine = Counter(text.split())
        scores = sorted((-sum(n * mine[w] for w, n in Counter(t.split()).items()), i) for i, t in texts.items())
        want += [(q, r + 1, i, float(-s)) for r, (s, i) in enumerate(x for x in scores if x[0]) if r < 4]
    rows = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    got = retrieval.topk_sparse_dot(rows(asked), rows(texts), 4, "id", "id")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_rows_of_one_item_add_up(spark):
    items = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "a a a b"), (3, None)], "item long, text string")
    asked = spark.createDataFrame([(9, "a b")], "q long, text string")
    got = retrieval.topk_sparse_dot(asked, items, 5, "q", "item")
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(9, 1, 2, 4.0), (9, 2, 1, 3.0)]


def test_terms_of_most_items_are_scored_for_all_at_once():
    """A block of queries meets all items; results are those of look-ups, ties and bounds included."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(4)
    words = np.array([f"t{i}" for i in range(12)])
    lists = lambda n, most: [list(r.choice(words, int(r.integers(0, most)), replace=False)) for _ in range(n)]
    some, asked = lists(20_000, 12), lists(30, 8)
    weights = lambda rows: pa.array([r.integers(1, 4, len(x)).astype(float) for x in rows], pa.list_(pa.float64()))
    items = pa.table({"item": pa.array(r.permutation(len(some))), "terms": pa.array(some, pa.list_(pa.string())), "weights": weights(some)})
    queries = {"q": pa.array(range(30)), "terms": pa.array(asked, pa.list_(pa.string())), "ws": weights(asked)}
    found = []
    for together in (True, False):
        chunk = postings._Chunk(items)
        if not together:
            chunk._common = lambda code, w, ends, bounds: np.zeros(len(bounds), dtype=bool)
        for bound in (float("-inf"), 5.0):
            q, i, s = chunk.best(pa.table(queries | {"bound": pa.array([bound] * 30)}), 5, True)
            found.append(sorted(zip(q.tolist(), i.tolist(), s.tolist())))
    assert found[0] == found[2] and found[1] == found[3] and found[0]
    chunk = postings._Chunk(items)
    chunk.weights_of = lambda *_: (_ for _ in ()).throw(AssertionError("a common term was looked up item by item"))
    assert len(chunk.best(pa.table({"q": [1], "terms": [["t0", "t1", "t2"]], "ws": [[1.0, 1.0, 1.0]], "bound": [float("-inf")]}), 5, True)[0]) == 5
