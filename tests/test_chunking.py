import random
import re

import pytest

from sparkassay.operators import chunking

PIECES = ["Hello there", "a", "Dr. No", "ünï cödé", "x" * 37, "  ", "\n", "\t", "end.", "what?", "wow!", "...", " "]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    made = ["", "   \n ", "one", "a. b. c.", "x" * 1000, ". . .", "no end", "   pad  "]
    for _ in range(n):
        made.append("".join(rng.choice(PIECES) + rng.choice([" ", "", ". ", "! ", "\n"]) for _ in range(rng.randint(1, 60))))
    return made


def fixed(text, size, overlap):
    out = []
    for start in range(0, len(text), size - overlap):
        body = text[start:start + size].strip()
        if body:
            out.append((len(out), body, start, min(start + size, len(text))))
    return out


def split(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]


def packed(text, limit, carry):
    out, held, size = [], [], 0
    for s in split(text):
        if held and size + len(s) + 1 > limit:
            out.append((len(out), " ".join(held), len(held)))
            held = held[-carry:] if carry else []
            size = sum(map(len, held))
        held.append(s)
        size += len(s) + 1
    if held:
        out.append((len(out), " ".join(held), len(held)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    made = texts()
    return made, spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("size,overlap", [(20, 5), (64, 0), (7, 6), (3, 1)])
def test_fixed(corpus, size, overlap):
    made, df = corpus
    got = {}
    for r in chunking.chunk_fixed(df, size=size, overlap=overlap).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.start_char, r.end_char))
    for i, t in enumerate(made):
        assert sorted(got.get(i, [])) == fixed(t, size, overlap)


def test_fixed_rejects_full_overlap(corpus):
    with pytest.raises(ValueError):
        chunking.chunk_fixed(corpus[1], size=10, overlap=10)


def test_fixed_windows_cover_long_text_past_one_block(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    rows = chunking.chunk_fixed(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=20, overlap=3).collect()
    assert sorted((r.chunk_index, r.text, r.start_char, r.end_char) for r in rows) == fixed(text, 20, 3)


def test_sentences(corpus):
    made, df = corpus
    got = {}
    for r in chunking.split_sentences(df).collect():
        got.setdefault(r.doc_id, []).append((r.sentence_index, r.sentence))
    for i, t in enumerate(made):
        assert [s for _, s in sorted(got.get(i, []))] == split(t)


@pytest.mark.parametrize("limit,carry", [(40, 1), (40, 0), (25, 3), (10, 64)])
def test_packing(corpus, limit, carry):
    made, df = corpus
    got = {}
    for r in chunking.chunk_sentence(df, max_size=limit, overlap=carry).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.sentence_count))
    for i, t in enumerate(made):
        assert sorted(got.get(i, [])) == packed(t, limit, carry)


def test_lines(corpus):
    made, df = corpus
    got = {}
    for r in chunking.chunk_lines(df).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    for i, t in enumerate(made):
        assert sorted(got.get(i, [])) == [(n, x.strip()) for n, x in enumerate(t.splitlines()) if x.strip()]


def test_index_inherits_metadata(spark):
    df = spark.createDataFrame([(1, "A b. C d.", {"source": "kb", "strategy": "old"}), (2, "  ", {"source": "x"})],
                               "doc_id long, text string, metadata map<string,string>")
    rows = chunking.index_documents(df, "sentence", "metadata").collect()
    assert len(rows) == 1
    assert rows[0].metadata == {"source": "kb", "chunk_index": "0", "sentence_count": "2", "strategy": "sentence"}
    with pytest.raises(ValueError):
        chunking.index_documents(df, "paragraph")
