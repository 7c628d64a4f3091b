import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkassay.operators import retrieval
from sparkassay.operators.topk import best_rows

RNG = np.random.default_rng(5)


def dense_frame(spark, n, name, dim=8, parts=3, dup=0.0):
    m = RNG.standard_normal((n, dim))
    if dup:
        m[: int(n * dup)] = m[0]  # a block of copies: equal scores, hot signature
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<double>")
    return m, df.repartition(parts)


def brute(qm, im, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(unit(qm) @ unit(im).T, 6)
    return {q: [(int(i), float(s[q, i])) for i in np.lexsort((np.arange(len(im)), -s[q]))[:k]] for q in range(len(qm))}


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.score))
    for v in out.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
    return {q: [(i, s) for _, i, s in v] for q, v in out.items()}


@pytest.mark.parametrize("nq,ni,options", [
    (40, 15, {}),  # items are the small side
    (15, 90, {}),  # queries are the small side
    (30, 90, {"max_rows": 0, "lanes": 3}),  # neither may be broadcast
])
def test_every_placement_is_exact(spark, nq, ni, options):
    qm, q = dense_frame(spark, nq, "q")
    im, i = dense_frame(spark, ni, "i", dup=0.4)
    got = collect(retrieval.topk_dense(q, i, 4, "q", "i", **options))
    want = brute(qm, im, 4)
    assert got.keys() == want.keys()
    for k in want:
        assert [x[0] for x in got[k]] == [x[0] for x in want[k]]
        assert np.allclose([x[1] for x in got[k]], [x[1] for x in want[k]], atol=2e-6)


def test_k_larger_than_index_and_empty_index(spark):
    _, q = dense_frame(spark, 3, "q")
    _, i = dense_frame(spark, 2, "i")
    assert {len(v) for v in collect(retrieval.topk_dense(q, i, 9, "q", "i")).values()} == {2}
    assert retrieval.topk_dense(q, i.limit(0), 9, "q", "i").count() == 0
    assert retrieval.topk_dense(q, i.limit(0), 9, "q", "i", max_rows=0).count() == 0


def test_zero_vector_scores_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q long, embedding array<double>")
    i = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0])], "i long, embedding array<double>")
    assert collect(retrieval.topk_dense(q, i, 2, "q", "i"))[1] == [(1, 0.0), (2, -1.0)]


def test_sparse_placements_agree(spark):
    words = [f"w{n}" for n in range(12)]
    text = lambda n: " ".join(RNG.choice(words, n))
    q = spark.createDataFrame([(i, text(4)) for i in range(12)] + [(99, "nothing shared")], "q long, text string")
    d = spark.createDataFrame([(i, "the " * (i % 3) + text(9)) for i in range(50)], "i long, text string").repartition(4)
    docs = {r.i: r.text.split() for r in d.collect()}
    want = {}
    for r in q.collect():
        terms = r.text.split()
        scored = [(i, float(sum(t.count(x) * terms.count(x) for x in set(terms)))) for i, t in docs.items()]
        want[r.q] = sorted([x for x in scored if x[1] > 0], key=lambda x: (-x[1], x[0]))[:3]
    want = {k: v for k, v in want.items() if v}
    for options in ({}, {"max_rows": 0, "lanes": 2}):
        assert collect(retrieval.topk_sparse_dot(q, d, 3, "q", "i", **options)) == want
    assert collect(retrieval.topk_bm25(q, d, 3, "q", "i")) == collect(
        retrieval.topk_bm25(q, d, 3, "q", "i", max_rows=0, lanes=2))


def test_supplied_sparse_weights(spark):
    q = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0])], "q long, terms array<string>, weights array<double>")
    i = spark.createDataFrame([(1, ["b", "c"], [0.5, 9.0]), (2, ["a"], [3.0]), (3, ["z"], [1.0])],
                              "i long, terms array<string>, weights array<double>")
    assert collect(retrieval.topk_sparse_weights(q, i, 5, "q", "i"))[1] == [(2, 3.0), (1, 1.0)]


def test_same_text_is_excluded(spark):
    rows = [(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.0]), (3, "y", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "i long, text string, embedding array<double>")
    assert collect(retrieval.topk_dense_excluding(df, df, 2, "i", "i", "text")) == {
        1: [(3, 0.0)], 2: [(3, 0.0)], 3: [(1, 0.0), (2, 0.0)]}


def test_fusion_counts_items_in_one_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item_id long, rank int")
    got = collect(retrieval.rrf([a, b], 3))[1]
    assert [x[0] for x in got] == [11, 10, 12]
    assert got[0][1] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6)
    assert [x[0] for x in collect(retrieval.rrf([a, a], 2))[1]] == [10, 11]  # identical lists keep their order


def test_approximate_recall(spark):
    wide = RNG.standard_normal((20, 16))
    items = np.repeat(wide, 15, axis=0) + 0.2 * RNG.standard_normal((300, 16))
    q = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(wide)], "q long, embedding array<double>")
    i = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(items)], "i long, embedding array<double>")
    exact = collect(retrieval.topk_dense(q, i, 5, "q", "i"))
    near = collect(retrieval.topk_ann(q, i, 5, "q", "i", dim=16))
    found = sum(len({x[0] for x in exact[k]} & {x[0] for x in near.get(k, [])}) for k in exact)
    assert found / 100 >= 0.9


def test_cells_cut_into_blocks_and_missing_vectors(spark, monkeypatch):
    from sparkassay.operators import cells

    qm, q = dense_frame(spark, 60, "q")
    im, i = dense_frame(spark, 400, "i", dup=0.4)  # one cell holds the copies
    null = spark.createDataFrame([(1000, None)], "q long, embedding array<double>")
    want = collect(retrieval.topk_dense(q, i, 4, "q", "i"))
    monkeypatch.setattr(cells, "CELL_ROWS", 30)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    # With every neighbour asked for, all needed cells are visited and the result is the exact one.
    got = collect(retrieval.topk_ann(q.union(null), i.union(null), 4, "q", "i", dim=8, target=1.0))
    found = sum(len({x[0] for x in want[n]} & {x[0] for x in got[n]}) for n in want)
    assert got.keys() == want.keys() and found >= 0.98 * 240
    assert all(s == pytest.approx(float(np.round(im[n] @ qm[k] / np.linalg.norm(im[n]) / np.linalg.norm(qm[k]), 6)), abs=2e-6)
               for k in got for n, s in got[k])
    assert retrieval.topk_ann(q, i.limit(0), 4, "q", "i", dim=8).count() == 0
    assert retrieval.topk_ann(q.limit(0), i, 4, "q", "i", dim=8).count() == 0
    assert collect(retrieval.topk_ann(q, i.filter("i = 3"), 4, "q", "i", dim=8)).keys() == want.keys()


def test_best_rows_ties_and_gaps():
    s = np.array([[1.0, np.nan], [1.0, np.nan], [0.5, 2.0], [1.0, np.nan]])
    rows, cols = best_rows(s, np.array([9, 3, 1, 5]), 2)
    assert list(zip(rows, cols)) == [(1, 0), (3, 0), (2, 1)]


def test_context_formats_and_empty(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    h = spark.createDataFrame([(1, 1, 0.126, "a", "kb"), (1, 2, 0.1, "b", None)], "qid long, rank int, score double, text string, src string")
    got = {r.qid: r.context for r in retrieval.context_block(q, "qid", h, F.col("src")).collect()}
    assert got == {1: "[1] (source: kb, score: 0.13)\na\n\n[2] (source: unknown, score: 0.10)\nb", 2: "No relevant context found."}


def test_dispatch_by_type_and_strategy(spark):
    q = spark.createDataFrame([(1, "a b", [1.0, 0.0])], "q long, text string, embedding array<double>")
    i = spark.createDataFrame([(1, "a b b", [0.0, 1.0]), (2, "c", [1.0, 0.0])], "i long, text string, embedding array<double>")
    top = lambda how: [x[0] for x in collect(retrieval.retrieve(q, i, how, 2, "q", "i"))[1]]
    assert top("dense") == top("rag") == top("rag_dense") == [2, 1]
    assert top("sparse") == top("rag_sparse") == [1]
    assert top("hybrid") == top("dspy") == [1, 2]
    with pytest.raises(ValueError):
        retrieval.retrieve(q, i, "lexical", 2, "q", "i")


def clustered(spark, n_clusters, each, dim=16, spread=0.02, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n_clusters, dim))
    m = np.repeat(centres, each, axis=0) + spread * r.standard_normal((n_clusters * each, dim))
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "i long, embedding array<double>").repartition(4)


def test_pivots_are_exact_and_skip_most_pairs_of_clusters(spark):
    from sparkassay.operators.pivots import PivotSearch
    from sparkassay.operators.topk import Side

    m, items = clustered(spark, 40, 30)
    queries = items.filter("i % 3 = 0").withColumnRenamed("i", "q")
    want = brute(m[::3], m, 4)
    got = collect(retrieval.topk_dense(queries, items, 4, "q", "i", max_rows=0, lanes=40))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {3 * q: [i for i, _ in v] for q, v in want.items()}
    search = PivotSearch(Side(queries, "q", ("embedding",)), Side(items, "i", ("embedding",)), retrieval.cosine_kernel, 4, 40)
    assert 0 < search.scored() < 0.15 * 400 * 1200


def test_pivots_with_zero_missing_and_tied_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(20)] + [(20 + i, [0.0, 0.0, 0.0]) for i in range(5)]
    rows += [(30, None), (31, [-1.0, 0.0, 0.0]), (32, [float("nan"), 1.0, 0.0]), (33, [0.0, 2.0, 0.0])]
    items = spark.createDataFrame(rows, "i long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [3.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 5.0]), (5, [-1.0, 0.0, 0.0])],
                                  "q long, embedding array<double>")
    got = collect(retrieval.topk_dense(asked, items, 22, "q", "i", max_rows=0, lanes=3))
    near = collect(retrieval.topk_dense(asked, items, 22, "q", "i"))
    assert got == near
    assert [i for i, _ in got[1]] == [*range(20), 20, 21] and [i for i, _ in got[5]][:2] == [31, 20] and 3 not in got
    empty = items.filter("i = 30")
    assert retrieval.topk_dense(asked, empty, 2, "q", "i", max_rows=0).count() == 0
    texts = asked.withColumn("text", F.lit("x")), items.withColumn("text", F.when(F.col("i") < 3, "x").otherwise("y"))
    assert [i for i, _ in collect(retrieval.topk_dense_excluding(*texts, 2, "q", "i", "text", max_rows=0))[1]] == [3, 4]


def test_postings_skip_blocks_and_stay_exact(spark):
    from sparkassay.operators import postings

    r = np.random.default_rng(11)
    vocabulary = [f"t{i}" for i in range(400)]
    # One term is in every document, the others fall off steeply.
    share = 1 / np.arange(1, 401)
    draw = lambda n: " ".join(r.choice(vocabulary, n, p=share / share.sum()))
    texts = ["all " * (1 + i % 4) + draw(30) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4)
    asked = spark.createDataFrame([(i, "all " + draw(5)) for i in range(40)] + [(90, "unknown words"), (91, None)], "q long, text string")
    index, n = retrieval.bm25_index(docs, "i")
    terms = retrieval.bm25_asked(asked, "q", index, n)
    small = postings.Postings(index.forward, postings.cut_blocks(index.forward, block=16), index.lexicon)
    bounded = collect(postings.search(terms, small, 5, "query_id", "item_id"))
    assert bounded == collect(postings.search(terms, small, 5, "query_id", "item_id", prune=False))
    assert bounded == collect(retrieval.topk_bm25(asked, docs, 5, "q", "i")) == collect(retrieval.topk_bm25(asked, docs, 5, "q", "i", max_rows=0))
    assert bounded.keys() == set(range(40))
    count = postings.read_share(terms, small, 5).first()
    assert 0 < count.n_read < 0.5 * count.n_postings


def test_negative_weights_and_missing_lists(spark):
    q = spark.createDataFrame([(1, ["a", "b"], [1.0, -2.0]), (2, ["a", "a"], [1.0, 0.5]), (3, None, None)],
                              "q long, terms array<string>, weights array<double>")
    i = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0]), (2, ["a"], [-1.0]), (3, ["b"], [1.0]), (4, None, None), (5, [], [])],
                              "i long, terms array<string>, weights array<double>")
    got = collect(retrieval.topk_sparse_weights(q, i, 2, "q", "i"))
    assert got == {1: [(2, -1.0), (3, -2.0)], 2: [(1, 1.5), (2, -1.5)]}


def test_vector_index_appends_equal_one_build(spark, tmp_path):
    from sparkassay.operators.vector_index import VectorIndex

    m, items = clustered(spark, 12, 20, dim=8)
    items = items.withColumn("note", F.concat(F.lit("n"), "i"))
    queries = items.filter("i % 4 = 0").select(F.col("i").alias("q"), "embedding")
    index = VectorIndex(spark, str(tmp_path / "index"), "i")
    assert index.count() == 0 and index.rows() is None and index.query(queries, "q", 3).count() == 0
    assert [index.add(items.filter("i < 100")), index.add(items.filter("i >= 100"))] == [1, 2]
    want = collect(retrieval.topk_dense(queries, items, 3, "q", "i"))
    assert index.count() == 240 and index.rows().filter("note = 'n7'").count() == 1
    for rows in (0, 20_000):
        assert collect(index.query(queries, "q", 3, max_rows=rows)) == want
    # A version written after the pivots were fitted is placed alone; rows without a line in the manifest are not read.
    extra = spark.createDataFrame([(999, [float(x) for x in m[0]], "late")], items.schema)
    extra.write.parquet(f"{tmp_path}/index/rows/version=7")
    assert index.count() == 240
    assert index.add(extra) == 3
    assert 999 in [i for i, _ in collect(index.query(queries, "q", 30, max_rows=0))[0]]
    index.reset()
    assert index.count() == 0 and index.query(queries, "q", 3).count() == 0
    index.add(extra)
    assert index.count() == 1 and {tuple(x for x, _ in v) for v in collect(index.query(queries, "q", 3, max_rows=0)).values()} == {(999,)}
