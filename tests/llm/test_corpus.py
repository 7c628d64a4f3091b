"""Token alignment, source divergence and exact duplicates against plain versions of the same."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkassay.llm import alignment, divergence, exact
from sparkassay.llm.queries import BYTE_VOCABULARY, PIECE_MODEL
from sparkassay.llm.worker import vocabulary_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary_path(BYTE_VOCABULARY))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECE_MODEL))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def tokens(text):
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        as_bytes = lambda p: bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        return (a.ids, [bytes(letter[c] for c in t) for t in a.tokens]), (b, [as_bytes(second.id_to_piece(i)) for i in b])

    return tokens


def plain_alignment(texts, tokens):
    """Every token pair of a document is compared by its byte range."""
    found, holding = [], Counter()
    for text in texts:
        out = ([], [], "", [])
        if text:
            (a, bytes_a), (b, bytes_b) = tokens(text)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in bs]).tolist() for bs in (bytes_a, bytes_b)]
                spans = [list(zip([0, *e[:-1]], e)) for e in ends]
                links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if s < v and u < e]
                both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
                for end in both:
                    to_i, to_j = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
                    i, j = to_i, to_j
                out = (a, b, ";".join(groups), links)
        found.append(out)
        holding.update(set(out[3]))
    best = defaultdict(int)
    for (a, _), n in holding.items():
        best[a] = max(best[a], n)
    return [(len(a), len(b), g.count(";") + 1 if a else 0, len(links), sum(holding[x] == best[x[0]] for x in links),
             sum(holding[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if a else "") for a, b, g, links in found]


@pytest.mark.parametrize("block_links", [alignment.BLOCK_LINKS, 50])
def test_alignment_matches_every_pair_compared(spark, libraries, block_links):
    r = random.Random(8)
    odd = list("abDEé ñÑΣςİ\x1c\x85\xa0\t\n\r're12٣½<|>.,!-字😀ﬁ▁ 　") + ["<|endoftext|>", "<s>", "'LL", "the ", "\n\n", "  ", "Hello "]
    texts = [None, "", " ", "\n", "x ▁y", "the the the", "same text, twice", "same text, twice", "überall Straße près de là\nzwei  Zeilen "]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(1, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sha string, block int").repartition(3)
    got = {row[0]: tuple(row)[1:] for row in alignment.token_alignment(docs, BYTE_VOCABULARY, PIECE_MODEL, block_links=block_links).collect()}
    want = plain_alignment(texts, libraries)
    assert [got[i] for i in range(len(texts))] == want
    assert len({w[6] for w in want}) > 100


def test_groups_of_texts_are_bounded():
    assert list(alignment.in_groups([3, 4, 9, 1, 1, 0], 7)) == [(0, 2), (2, 3), (3, 6)] and list(alignment.in_groups([])) == []


def test_align_jumps_runs_and_settles_groups():
    r = random.Random(2)
    for _ in range(300):
        last = r.randint(1, 120)
        a, b = (np.array(sorted({last, *(r.randint(1, last) for _ in range(r.randint(0, last)))})) for _ in range(2))
        stretches, at_a, at_b = alignment.align(a, b)
        ends = sorted(set(a.tolist()) | set(b.tolist()))
        assert at_a == np.searchsorted(a, ends).tolist() and at_b == np.searchsorted(b, ends).tolist()
        groups = [e for i, to_i, _, _, plain in stretches for e in (a[i:to_i].tolist() if plain else [int(a[to_i - 1])])]
        assert groups == sorted(set(a.tolist()) & set(b.tolist()))
    long = np.arange(1, 5000)
    assert alignment.align(long, long)[0] == [(0, 4999, 0, 4999, True)]


def test_alignment_of_awkward_tables(spark, docs, no_docs, texts):
    got = alignment.token_alignment(docs, BYTE_VOCABULARY, PIECE_MODEL)
    assert got.count() == docs.count() and got.filter("doc_id is null and n_a > 0").count() == 1
    assert alignment.token_alignment(no_docs, BYTE_VOCABULARY, PIECE_MODEL).count() == 0
    # The repeated row is a document of its own, so its only links are held by two documents and more.
    twice = got.filter("doc_id = 5").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


# -- divergence


def plain_audit(table, min_docs=3, top=200):
    """Exact integers over every kept term, group and pair."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for lang, source, text in table]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, terms in mine for t in set(terms))
        kept = [t for t, n in df.items() if n >= min_docs]
        sources = sorted({d[1] for d in mine})
        count = {s: Counter(t for _, x, terms in mine if x == s for t in terms) for s in sources}
        everywhere = Counter()
        for c in count.values():
            everywhere.update(c)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        probability, whole = {s: p(count[s]) for s in sources}, p(everywhere)
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            far = [(sum(f(probability[s][t], probability[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(f(probability[s][t], whole[t]), t) for t in kept if count[s][t] and probability[s][t] > whole[t]]
            for part, items in (("pair", far), ("term", own)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items, 1) if part == "pair" or rank <= top]
    return sorted(out, key=repr)


def some_documents(n, seed=1):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Ärger", "字", "naïve", "İx", "the", "THE"]
    return [(r.choice(["en", "en", "en", "de", None]), r.choice(["a", "a", "a", "a", "b", "c", "é", "", None]),
             r.choice([None, "", "1 2 - 3"]) if r.random() < 0.1 else " ".join(r.choice(words[:r.choice([5, 40, 86])]) for _ in range(r.randint(1, 60))))
            for _ in range(n)]


def test_divergence_matches_plain_integers(spark):
    table = some_documents(250) + [("xx", "only", "words here"), ("yy", "a", ""), ("yy", "b", None)]
    docs = spark.createDataFrame(table, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("gid", F.lit("g"))
    got = divergence.audit(docs.repartition(5))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows(got) == plain_audit(table)
    assert rows(divergence.audit(docs, min_docs=5, top_terms=3)) == plain_audit(table, 5, 3)


def test_stripes_spill_and_meet_again(spark):
    docs = spark.createDataFrame(some_documents(120), "lang string, source string, text string").na.fill("").withColumn("text", F.col("text").cast("binary"))
    whole = divergence.merge_stripes(divergence.fold_stripes(docs.coalesce(1)))
    small = divergence.merge_stripes(divergence.fold_stripes(docs.repartition(4), spill=7))

    def plain(df):
        return sorted((r[0], bytes(r[1] or b""), r[2], sorted(zip(r[3], r[4]))) for r in df.collect())

    assert divergence.fold_stripes(docs.coalesce(1), spill=7).count() > whole.count()
    assert plain(whole) == plain(small)


def test_divergence_of_shared_terms_in_small_chunks(spark, monkeypatch):
    table = some_documents(150, seed=9)
    docs = spark.createDataFrame(table, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "CHUNK", 5)
    monkeypatch.setattr(divergence, "SPILL", 6)
    assert rows(divergence.audit(docs)) == plain_audit(table)


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(none).count() == 0
    assert divergence.audit(spark.createDataFrame([("en", "a", "one")], none.schema)).count() == 0
    assert rows(divergence.audit(spark.createDataFrame([("en", "a", "x"), ("en", "b", "y")], none.schema))) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# -- exact duplicates


def plain_duplicates(table):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sha = lambda t: hashlib.sha256((t or "").translate(lower).encode()).hexdigest()
    groups = defaultdict(list)
    for key, text in table:
        groups[sha(text)].append(key)
    top = {h: max(keys, key=lambda k: (k is not None, k or 0)) for h, keys in groups.items()}
    return sorted(((k, top[sha(t)], len(groups[sha(t)]), k == top[sha(t)], sha(t)) for k, t in table), key=repr)


def test_exact_duplicates_match_plain_groups(spark):
    r = random.Random(6)
    texts = [None, "", "Straße", "STRASSE", "É", "é", "İ", "i̇", "a", "A", "x" * 50_000, "X" * 50_000]
    table = [(i, r.choice(texts) if r.random() < 0.3 else "Hot Text" if r.random() < 0.4 else f"Text {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("row", F.lit("r"))
    got = exact.exact_duplicates(docs.repartition(7))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows(got) == plain_duplicates(table)
    kept = exact.deduplicate(docs.repartition(5))
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(k for k, _, _, stays, _ in plain_duplicates(table) if stays)


def test_full_and_tiny_filters_change_nothing(spark, monkeypatch):
    table = [(i, f"t{i % 700}") for i in range(1000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(exact, "LEAST_BITS", 1 << 6)
    monkeypatch.setattr(exact, "MOST_BITS", 1 << 6)
    assert rows(exact.exact_duplicates(docs)) == plain_duplicates(table)
    monkeypatch.setattr(exact, "MOST_BITS", 1 << 12)
    monkeypatch.setattr(exact, "SEGMENT", 16)
    monkeypatch.setattr(exact, "HOT_GROUPS", 2)
    assert rows(exact.exact_duplicates(docs)) == plain_duplicates(table)


def test_only_possible_repeats_are_flagged(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.greatest("id", F.lit(99))).alias("text"))
    digests = docs.select("doc_id", exact.text_digest(F.col("text")).alias("digest")).repartition(8)
    data = exact.repeated_filter(digests, exact.filter_bits(20_000))
    flagged = exact.flag_repeated(digests, "digest", data, "maybe")
    assert flagged.filter("doc_id <= 99 and not maybe").count() == 0
    assert flagged.filter("doc_id > 99 and maybe").count() < 20


def test_exact_duplicates_of_awkward_tables(spark, docs, no_docs):
    got = exact.exact_duplicates(docs)
    assert got.count() == docs.count()
    # One row of each text stays, also where an id repeats or is missing.
    texts = docs.select(F.lower(F.hex(exact.text_digest(F.col("text"))))).distinct().count()
    assert got.filter("kept").count() == texts == exact.deduplicate(docs).count()
    assert exact.exact_duplicates(no_docs).count() == 0 and exact.deduplicate(no_docs).count() == 0
    both = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (3, "B"), (1, "b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.keep_id, r.kept) for r in exact.exact_duplicates(both).collect() if r.doc_id is not None) == [
        (False, 3, False), (False, 3, False), (False, 3, True)]
    assert exact.deduplicate(both).count() == 2
