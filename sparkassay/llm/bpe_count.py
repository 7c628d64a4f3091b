"""Token counts by byte-pair merging with a heap over a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.worker import spread, vocabulary_path, worker_cache

#: Words remembered by one Python worker before it starts afresh; bounds memory, not the input.
MEMO_WORDS = 400_000
#: Word pieces as the vocabulary's pre-tokenizer cuts them (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """One printable letter per byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [moved.get(b, chr(b)) for b in range(256)]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the adjacent pair of lowest rank (ties: leftmost) is merged until no pair has a rank.

    Symbols are a doubly linked list over positions; the heap holds pairs that were adjacent when pushed, and a
    popped pair counts only if both of its symbols still stand there.
    """
    n = len(symbols)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    sym: list[str | None] = list(symbols)
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        merges += 1
        sym[i], sym[j] = a + b, None
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for left, right in ((prv[i], i), (i, nxt[i])):
            if left >= 0 and right < n and (r := ranks.get((sym[left], sym[right]))) is not None:
                heapq.heappush(heap, (r, left, sym[left], sym[right]))
    return n - merges


def text_counter(vocab: str, memo_words: int = MEMO_WORDS):
    """``count(text) -> int`` for a word-end byte-pair vocabulary file.

    Special strings inside a text count one token each, as the library's default has it; what stands between them
    is normalised, cut into pieces and merged piece by piece. ASCII parts are cut here; others by the library's own
    normaliser and pre-tokenizer, whose character classes and cases are not Python's.
    """

    def make():
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path(vocab))
        normal, cut_other = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        with open(vocabulary_path(vocab), encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        ranks = {(p[0], p[1]) if isinstance(p, list) else tuple(p.split(" ")): i for i, p in enumerate(spec["model"]["merges"])}
        letters, cut = byte_letters(), regex.compile(PIECES)
        special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")

        class Memo(dict):
            def __init__(self, work):
                super().__init__()
                self.work = work

            def __missing__(self, key: str) -> int:
                if len(self) >= memo_words:
                    self.clear()
                found = self[key] = self.work(key)
                return found

        def lettered(p: str) -> int:
            """A piece whose bytes are already letters."""
            symbols = list(p)
            symbols[-1] += suffix
            return count_merged(symbols, ranks)

        others = Memo(lettered)
        pieces = Memo(lambda p: lettered("".join([letters[b] for b in p.encode("utf-8")])))

        def part(s: str) -> int:
            if s.isascii():
                return sum([pieces[p] for p in cut.findall(s.lower())])
            return sum([others[p] for p, _ in cut_other(normal(s)) if p])

        def word(w: str) -> int:
            if "<" not in w:
                return part(w)
            return sum([part(s) for s in special.split(w)]) + len(special.findall(w))

        return Memo(word)

    memo = worker_cache(f"bpe_count:{vocab}:{memo_words}", make)
    return lambda text: sum([memo[w] for w in text.replace("\n", " ").split(" ") if w]) if text else 0


def count_tokens(docs: DataFrame, vocab: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null or empty text has zero bytes and tokens. Null ids and repeated rows keep one result row each; other
    columns are ignored. No shuffle: every text is counted where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(vocab)
        for batch in batches:
            counts = [count(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                  names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = spread(rows).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
