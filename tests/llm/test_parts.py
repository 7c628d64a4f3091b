"""Texts are aligned part by part, and token files are checked where they are unpacked."""

import random
import zlib

import numpy as np

from sparkassay.llm import alignment, pfor
from sparkassay.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, VOCABULARY


def test_parts_give_what_whole_texts_give_and_are_encoded_once(monkeypatch):
    v = alignment.vocabularies(BYTE_VOCABULARY, PIECE_MODEL)
    seen = []
    parts = v._replace(parts={}, before={}, encode_parts=lambda p: seen.extend(p) or v.encode_parts(p))
    whole = v._replace(encode_parts=None)
    r = random.Random(6)
    odd = ["a", "the", "ing", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\xa0", "　", "'s", "é", "中", "▁", "<|endoftext|>", "<0x0A>", "<s>", "12", "."]
    texts = [None, "", " ", "\n"] + ["".join(r.choice(odd) for _ in range(r.randint(1, 30))) for _ in range(600)]
    same = lambda x, y: x[:3] == y[:3] and np.array_equal(x[3], y[3])
    assert all(map(same, alignment.aligned_texts(texts, parts), alignment.aligned_texts(texts, whole)))
    seen.clear()
    assert [x[2] for x in alignment.aligned_texts(["one two\none two", "two one"], parts)] == [
        x[2] for x in alignment.aligned_texts(["one two\none two", "two one"], whole)]
    assert len(seen) == len(set(seen)) <= 4
    seen.clear()
    list(alignment.aligned_texts(["two two one"], parts))
    assert not seen
    # What is remembered is bounded.
    monkeypatch.setattr(alignment, "MEMO_PARTS", 10)
    list(alignment.aligned_texts([f"w{i}" for i in range(50)], parts))
    list(alignment.aligned_texts(["x y z"], parts))
    assert len(parts.parts) < 10


def test_files_are_checked_where_they_are_unpacked(spark, docs):
    path = pfor.write_token_files(docs, VOCABULARY)
    stored = {(r.file, r.nth): zlib.crc32(r.ids) for r in pfor.read_token_files(spark, path).collect()}
    checked = pfor.read_token_files(spark, path, digest=True)
    assert {(r.file, r.nth): r.ids_crc32 for r in checked.collect()} == stored
    assert checked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
