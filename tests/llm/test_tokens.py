"""Token counts, token files and packing against the tokenizers library."""

import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkassay.llm import bpe_count, packing, pfor

VOCAB = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCAB))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_counts_equal_the_library(docs, texts, ids):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.count_tokens(docs, VOCAB).collect())
    rows = [*enumerate(texts), (None, "no id here"), (5, texts[5])]
    assert got == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 2048) for i, t in rows)


def test_merging_pops_lowest_rank_leftmost():
    ranks = {("a", "a"): 0, ("aa", "a"): 1, ("b", "c"): 2}
    assert [bpe_count.count_merged(list(w), ranks) for w in ("aaaa", "aaa", "abc", "x")] == [2, 1, 2, 1]


def test_empty_tables(no_docs):
    assert bpe_count.count_tokens(no_docs, VOCAB).count() == 0
    assert packing.pack(no_docs, VOCAB).count() == 0
    assert pfor.token_index(no_docs.sparkSession, pfor.write_token_files(no_docs, VOCAB)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, top):
    values = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    values[: n // 50] = 2**32 - 1
    assert (pfor.unpack_blocks(*pfor.pack_blocks(values), n) == values).all()


def test_files_hold_every_id(spark, docs, texts, ids):
    path = pfor.write_token_files(docs.filter("doc_id is not null"), VOCAB)
    rows = sorted([*enumerate(texts), (5, texts[5])], key=lambda r: r[0])
    want, start = Counter(), 0
    for i, t in rows:
        data = struct.pack(f"<{len(ids(t)) + 1}I", *ids(t), 2)
        want[(i, start, len(data) // 4, zlib.crc32(data))] += 1
        start += len(data) // 4
    assert Counter(tuple(r) for r in pfor.token_index(spark, path).collect()) == want
    assert {bytes(r.ids) for r in pfor.read_token_files(spark, path).filter("doc_id = 3").collect()} == {
        struct.pack(f"<{len(ids(texts[3])) + 1}I", *ids(texts[3]), 2)}


def test_packing_is_gapless_and_whole(docs, texts, ids):
    rows = packing.pack(docs, VOCAB, capacity=512).collect()
    want = Counter()
    for i, t in [*enumerate(texts), (None, "no id here"), (5, texts[5])]:
        all_ids = [*ids(t), 0]
        for p in range(0, len(all_ids), 512):
            part = all_ids[p:p + 512]
            want[(i, p // 512, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in rows)
    assert max(filled.values()) <= 512 and len(filled) <= -(-total // 512) + 1


def test_plan_is_close_to_the_bound():
    r = random.Random(1)
    histogram = Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    plan = packing.plan_sequences(dict(histogram), 2048)
    held = Counter()
    for lengths, many in plan:
        assert sum(lengths) <= 2048
        for n in lengths:
            held[n] += many
    assert held == histogram
    bound = sum(n * c for n, c in histogram.items()) / 2048
    assert sum(m for _, m in plan) <= bound * 1.005 + 1


@pytest.mark.parametrize("histogram", [{}, {2048: 5}, {1: 10_000}, {1025: 7}, {683: 9, 682: 3}])
def test_plan_of_plain_histograms(histogram):
    plan = packing.plan_sequences(histogram, 2048)
    held = Counter()
    for lengths, many in plan:
        for n in lengths:
            held[n] += many
    assert held == Counter(histogram)


def test_ids_and_counts_of_every_code_point(ids):
    """Inside a word and between signs; the library's character classes and cases are not Python's."""
    from sparkassay.llm.wordids import word_encoder

    encode, count = word_encoder(VOCAB), bpe_count.text_counter(VOCAB)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 61 == 0)]
    for k in range(0, len(points), 40):
        text = " ".join(f"a{chr(c)}b !{chr(c)}!" for c in points[k:k + 40])
        want = ids(text)
        assert np.frombuffer(encode(text), "<u4").tolist() == want and count(text) == len(want), hex(points[k])


def test_ids_and_counts_of_random_mixed_texts(ids):
    from sparkassay.llm.wordids import word_encoder

    encode, count, r = word_encoder(VOCAB), bpe_count.text_counter(VOCAB), random.Random(21)
    kinds = [lambda: r.randrange(1, 0x300), lambda: r.randrange(32, 127), lambda: 32, lambda: 10, lambda: r.randrange(0x300, 0xD800), lambda: 0x301]
    for _ in range(4000):
        text = "".join(chr(r.choice(kinds)()) for _ in range(r.randint(1, 30)))
        want = ids(text)
        assert np.frombuffer(encode(text), "<u4").tolist() == want and count(text) == len(want), text


def test_latin_words_are_cut_here(ids, monkeypatch):
    """Words with Latin letters beyond ASCII cost the library one look at each piece, not a pass over each word."""
    import re

    import tokenizers

    from sparkassay.llm import wordids

    latin = [c for c in map(chr, range(0x180)) if re.fullmatch(f"[{wordids.LATIN}]", c)]
    r = random.Random(8)
    texts = ["x" + a + b for a in latin[128:] for b in latin[::7]] + ["".join(r.choices(latin, k=r.randint(1, 12))) for _ in range(2000)]
    texts = [t for t in texts if "<" not in t]
    want = [struct.pack(f"<{len(x)}I", *x) for x in map(ids, texts)]

    class Pieces:
        def __init__(self, whole):
            self.model = whole.model

        @classmethod
        def from_file(cls, path, whole=tokenizers.Tokenizer.from_file):
            return cls(whole(path))

    monkeypatch.setattr(tokenizers, "Tokenizer", Pieces)
    encode = wordids.word_encoder(VOCAB, 200_001)
    assert [encode(t) for t in texts] == want


def test_words_asked_for_again_and_again_outlive_a_full_memo():
    from sparkassay.llm.worker import worker_cache
    from sparkassay.llm.wordids import word_encoder

    encode = word_encoder("word_bpe_49k.json", 16)
    memo = worker_cache("wordids:word_bpe_49k.json:16", dict)
    work, made = memo.work, []
    memo.work = lambda w: made.append(w) or work(w)
    for k in range(300):
        assert encode(f"often rare{chr(97 + k % 26)}{chr(97 + k // 26)}") == word_encoder("word_bpe_49k.json")(f"often rare{chr(97 + k % 26)}{chr(97 + k // 26)}")
    assert made.count("often") == 1


def test_numbers_of_every_width_come_back_from_their_blocks():
    import numpy as np

    from sparkassay.llm import pfor

    rng = np.random.default_rng(5)
    for top in [1 << b for b in range(33)]:
        ids = rng.integers(0, top, 300, dtype=np.uint64).astype(np.uint32)
        assert (pfor.unpack_blocks(*pfor.pack_blocks(ids), len(ids)) == ids).all()
