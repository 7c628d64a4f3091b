"""Near vectors, SimHash, decontamination and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sparkassay.llm import components, decontam, itq, simhash


def classes(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tree_finds_every_close_pair():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in r.integers(0, 8, 12)] + [base]))
    tree = simhash.build_tree(points)
    q, n = simhash.search_tree(tree, points, points, 2)
    assert set(zip(q.tolist(), n.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(
        np.bitwise_count(points[:, None] ^ points[None, :]) <= 2))))


@pytest.mark.parametrize("nodes", [4096, 3])
def test_links_keep_the_components(spark, nodes):
    r = np.random.default_rng(5)
    points = {int(x) for x in r.integers(0, 2**62, 30)}
    for x in list(points):
        points |= {x ^ (1 << int(b)) ^ (1 << int(c)) for b, c in r.integers(0, 63, (4, 2))}
    points = sorted(points)
    pairs = [(i, j) for i, a in enumerate(points) for j, b in enumerate(points[:i]) if (a ^ b).bit_count() <= 2]
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    found = {r.node: r.component for r in components.components(simhash.close_links(df, 2, nodes)).collect()}
    mine = [found.get(p, p) for p in points]
    want = classes(len(points), pairs)
    assert Counter(Counter(mine).values()) == Counter(Counter(want).values())
    assert len(set(zip(mine, want))) == len(set(want))


def test_simhash_of_whole_texts(docs, texts):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fingerprint(t)) for i, t in enumerate(texts)]
    root = classes(len(rows), [(i, j) for i, a in rows for j, b in rows[:i] if (a ^ b).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in rows}
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(docs.filter("doc_id = -5")).count() == 0


def test_pipeline_keeps_one_of_each_near_copy(spark):
    r = random.Random(12)
    rows = []
    for size in (6, 20, 60, 150, 400):
        for _ in range(8):
            base = [f"w{r.randrange(5000)}" for _ in range(size)]
            for edits in (0, 0, 1, 2, 4, 8):
                copy = list(base)
                for at in r.sample(range(size), min(edits, size)):
                    copy[at] = f"x{r.randrange(5000)}"
                rows.append((r.randrange(1 << 40), " ".join(copy)))
    hub = [f"h{k}" for k in range(100)]
    # Both ends are near the middle, none of them the smallest id of its cell.
    rows += [(k, " ".join(hub[k * 5:k * 5 + 80])) for k in (3, 1, 2, 4)] + [(5, "short text"), (6, "Short  text"), (7, "other text")]
    r.shuffle(rows)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) * 5 >= len(a | b) * 4]
    assert sum(sets[i] != sets[j] for i, j in pairs) > 50
    group = {}
    for (i, _), c in zip(rows, classes(len(rows), pairs)):
        group[c] = min(i, group.get(c, i))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(group.values())


def test_near_vectors(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal((25, 16))
    v = np.concatenate([base + s * r.standard_normal(base.shape) for s in (0, 0.04, 0.06, 0.08)] + [base[:3], 2 * base[:3]])
    labels = [int(x) for x in r.integers(0, 3, 25)] * 4 + [0] * 6
    rows = [(i, x.tolist(), lab) for i, (x, lab) in enumerate(zip(v, labels))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] * 8, 1), (903, [float("nan")] * 16, 1), (904, base[0].tolist(), None),
             (905, [], 1), (906, [1.0, 2.0], 1), (907, [1e200] * 16, 2), (908, [1e-200] * 16, 2), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame([(*x, "z", 0) for x in rows], "vec_id long, embedding array<double>, label int, v string, k int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(close, False)
    root = classes(len(v), list(zip(*np.nonzero(close))))
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in itq.near_vectors(df).collect()}
    assert {i: got[i] for i in range(len(v))} == {i: (int(close[i].sum()), root[i], root[i] == i) for i in range(len(v))}
    assert all(got[i] == (0, i, True) for i in range(900, 907)) and got[907] == (1, 907, True) and got[908] == (1, 907, False)
    assert got[None][0] == 0 and not got[None][2]
    assert itq.near_vectors(df.filter("vec_id = -1")).count() == 0


def test_half_the_budget_from_either_side_loses_no_pair():
    r = np.random.default_rng(8)
    a = r.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + 0.025 * r.standard_normal(a.shape)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = np.flatnonzero((a * b).sum(axis=1) >= 0.98)
    assert len(pairs) > 30
    mean, projection = itq.fit_rotation(np.concatenate([a, b]))
    found = set()
    for t in range(4):
        x, y = (((m - mean) @ projection)[:, 16 * t:16 * t + 16] for m in (a, b))
        for probe, item in ((x, y), (y, x)):
            row, code = itq.flips(probe, 0.02 / 4 + itq.SLACK)
            found |= set(row[code == itq.flips(item, -1.0)[1][row]].tolist())
    assert set(pairs.tolist()) <= found


WORDS = "ab cd efg hij kl mnop qrs tu vw xyz one two three four five six seven eight nine ten".split()


def test_leaks_are_found_and_clean_texts_left(spark):
    r = random.Random(8)
    item = [[r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)] for n in (12, 25, 40)]

    def noise(n):
        return [r.choice(WORDS) + str(r.randint(41, 99)) for _ in range(n)]

    rows, want = [], set()
    for k, words in enumerate(item):
        for j in range(10):
            copy = list(words)
            for p in r.sample(range(len(copy)), int(len(copy) * 0.2 * (j % 3) / 2)):
                copy[p] = "changed"
            rows.append((len(rows), " ".join(noise(j * 7) + [w.upper() + "," for w in copy] + noise(9))))
            want.add((rows[-1][0], k))
    rows += [(500 + i, " ".join(noise(200))) for i in range(10)] + [(600, None), (601, ""), (None, " ".join(item[0])), (602, "a " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS item_id")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(item)] + [(7, None), (8, ""), (9, "too few words")], "item_id long, text string")
    hits = decontam.contaminated(docs, bench).collect()
    assert {(h.doc_id, h.item_id) for h in hits} == want
    assert all(h.similarity >= 0.8 for h in hits)
    small = decontam.contaminated(docs, bench, block_bytes=60).collect()
    assert {(h.doc_id, h.item_id) for h in small} == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(want)
    assert decontam.contaminated(docs, bench.filter("item_id < 0")).count() == 0
    assert decontam.contaminated(docs.filter("doc_id < 0"), bench).count() == 0


def test_short_and_unspaced_items(spark):
    def words(t):
        return len(decontam.word_hashes([t])[0])

    assert words("你好，世界") == 4 and words("abc「def」ghi") == 3 and words("“one” – two…") == 2 and words("学a1生b") == 4
    assert words("ที่นี่") == 2 and words("カ\u3099") == 1 and words("naïve cafe\u0301s Ελλάδα 한국어 हिन्दी ١٢٣") == 6
    han = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    items = [(1, "exact four word item"), (2, "Solo"), (3, han), (4, "two words"), (5, "スシを食べる"), (6, " ,. "), (7, "two words"), (8, "one, two — three")]
    docs = [(1, "x an EXACT, four word item; y"), (2, "exact four words item"), (3, f"前文{han}后文"), (4, f"前文{han[:8]}错{han[9:]}后文"),
            (5, han[:10]), (6, "a solo, solo piece of two\u3000words"), (7, "友達とスシを食べる。"), (8, "one—two… three"), (9, "two"), (10, "words of two")]
    hits = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((h.doc_id, h.item_id) for h in hits) == Counter([(1, 1), (3, 3), (4, 3), (6, 2), (6, 4), (6, 7), (7, 5), (8, 8)])
    got = {(h.doc_id, h.item_id): h for h in hits}
    assert (got[1, 1].first_word, got[1, 1].n_words, got[1, 1].similarity) == (2, 4, 1.0) and got[6, 2].first_word == 1
    assert got[4, 3].similarity == 0.95


def test_edit_distance_to_the_best_stretch():
    a = lambda s: np.array([ord(c) for c in s])
    assert decontam.infix_distance(a("abc"), a("xxabcxx")) == (0, 5)
    assert decontam.infix_distance(a("abcd"), a("xxacdxx"))[0] == 1
    assert decontam.infix_distance(a("abc"), a(""))[0] == 3


@pytest.mark.parametrize("n", [5, 6, 8, 10, 12, 13, 16, 30])
def test_recall_at_every_length(n):
    r = random.Random(n)
    word = lambda: r.choice(["the", "of", "and", *(f"w{k}" for k in range(9))]) if r.random() < 0.2 else f"v{r.randrange(3000)}"
    items = [[word() for _ in range(n)] for _ in range(200)]

    def edited(item, edits):
        out = list(item)
        for at in sorted(r.sample(range(n), edits), reverse=True):
            out[at:at + 1] = r.choice([[word()], [], [out[at], word()]])
        return out

    index = decontam.ItemIndex(list(range(200)), [" ".join(i) for i in items])
    for edits, recall in ((0, 1.0), (int(n * 0.2), 0.95)):
        texts = [" ".join([word() for _ in range(15)] + edited(i, edits) + [word() for _ in range(15)]) for i in items]
        found = {(d, i) for d, i, *_ in decontam.search_group(index, texts, 0.8, 1)}
        assert sum((k, k) in found for k in range(200)) >= recall * 200


def test_hits_held_at_a_time_change_nothing(monkeypatch):
    r = random.Random(8)
    word = lambda: r.choice(["the", "of", *(f"w{n}" for n in range(60))])
    items = [" ".join(word() for _ in range(n)) for n in (5, 12, 30, 90)] + ["same " * 40]
    texts = [" ".join([word() for _ in range(20)] + items[k % 5].split() + [word() for _ in range(9)]) for k in range(30)] + ["same " * 300, None, ""]
    # An item's copies under other ids are found as well.
    ids, held = [*range(5), 10, 11, 14], [*items, items[0], items[0], items[4]]
    find = lambda: sorted(decontam.search_group(decontam.ItemIndex(ids, held), texts, 0.8, 1))
    whole = find()
    assert {(d, i) for d, i, *_ in whole} >= {(k, k % 5) for k in range(30)} | {(k, 10) for k in range(0, 30, 5)} | {(30, 4), (30, 14)}
    for size in (1, 50):
        monkeypatch.setattr(decontam, "HITS", size)
        monkeypatch.setattr(decontam, "CELLS", 10 * size)
        assert find() == whole


def test_long_labels_are_told_apart(spark):
    long = "l" * 70
    rows = [(1, long + "a", [1.0, 0.0]), (2, long + "b", [1.0, 0.0]), (3, long + "b", [2.0, 0.0])]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (0, 1), 2: (1, 2), 3: (1, 2)}


def test_pipeline_links_over_fingerprints(spark, monkeypatch):
    """Near copies within two bits meet over the trees of ``simhash`` even where no MinHash band is shared; exact sets still decide."""
    from sparkassay.llm import jaccard

    r = random.Random(12)
    texts = {}
    for n in range(6):
        words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
        texts[10 * n], prints = " ".join(words), simhash.text_fingerprint(" ".join(words))
        copies = (" ".join(words[:i] + ["other"] + words[i + 1:]) for i in range(0, 3000, 50))
        near = next(t for t in copies if 0 < (simhash.text_fingerprint(t) ^ prints).bit_count() <= 2)
        texts[10 * n + 1] = near
    # One line so often that it alone makes the fingerprint, and words of their own: no near copies.
    texts[100], texts[101] = ("a b c d e " * 1000 + " ".join("".join(r.choices("klmnopq", k=6)) for _ in range(200)) for _ in range(2))
    assert (simhash.text_fingerprint(texts[100]) ^ simhash.text_fingerprint(texts[101])).bit_count() <= 2
    keys = lambda hashes, bands=20, rows=5: np.random.default_rng(hashes.view(np.uint32)).integers(0, 2**62, bands)
    monkeypatch.setattr(jaccard, "band_keys", keys)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id for x in jaccard.keep_one(docs).collect()} == {0, 10, 20, 30, 40, 50, 100, 101}


def test_a_stage_keeps_nothing_of_the_stage_before(spark):
    import pyarrow as pa

    from sparkassay.llm import decontam, jaccard, worker

    held = worker.worker_cache("langid:1024:3:40000", lambda: ["table"])
    assert worker.worker_cache("langid:1024:3:40000", list) is held
    worker.worker_cache("decontam:kept", lambda: 1)
    worker.forget_others("decontam:")
    assert worker.worker_cache("langid:1024:3:40000", list) == [] and worker.worker_cache("decontam:kept", lambda: 2) == 1
    # The tasks of both stages that follow the language stage do so.
    def left(batches):
        import sys

        items = sys.modules["_sparkassay_worker"].items if "_sparkassay_worker" in sys.modules else {}
        for batch in batches:
            yield pa.record_batch([pa.array([sum(k.startswith("langid:") for k in items)])], names=["n"])

    docs = spark.createDataFrame([(k, f"some words of text number {k} " * 5, "en") for k in range(8)], "doc_id long, text string, lang string").coalesce(1)
    from sparkassay.llm import langid

    langid.predict(docs).collect()
    jaccard.sketches(docs.coalesce(1)).collect()
    decontam.clean(docs, spark.createDataFrame([(1, "quite other words than these")], "item_id long, text string")).collect()
    assert sum(r.n for r in docs.mapInArrow(left, "n long").collect()) == 0
