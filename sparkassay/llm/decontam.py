"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A text is its lower-cased words. Every window walks over its words: each step copies the word under the pointer, and
a random function of the step and the word decides whether the pointer moves. Windows that differ by few edits walk
in step again soon after each edit, so edit distance becomes Hamming distance between the copied words, and a sample
of steps is a locality-sensitive key. Several walks with their own randomness and samples are repeated; benchmark
items give a key for the window at each of their words, documents at every ``stride``-th word. Windows that share a
key are candidates, and a candidate counts only when the exact word edit distance of the item to the best matching
stretch of the document leaves the wanted similarity. Items of under ``MIN_WORDS`` words allow no edit and are looked
up as exact word sequences.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.worker import forget_others, give_back, spread, worker_cache

#: Items with fewer words have no windows; their word sequence is looked up as it is.
MIN_WORDS = 5
SIMILARITY = 0.8
#: Repeated walks, steps of a walk, steps sampled into a key and the least distance between them.
WALKS, STEPS, SAMPLED, GAP = 8, 16, 5, 3
#: Items of fewer words have walks of their own, which seldom leave so short an item: more of them, each shorter.
SHORT_WORDS = 13
SHORT_WALKS, SHORT_STEPS, SHORT_SAMPLED, SHORT_GAP = 24, 6, 3, 2
#: Words that a window of a short item has at least.
SHORT_WINDOW = 3
STRIDE = 1
#: Text bytes of benchmark items that one pass over the documents takes along.
BLOCK_BYTES = 16 << 20
#: Text bytes worked on together inside a task; a longer document is worked on alone.
GROUP_BYTES = 1 << 18
#: Window hits, and cells of one alignment matrix, held at a time.
HITS, CELLS = 1 << 20, 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""

    def make(size: int):
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            return [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
                    for b in (np.uint64(_BASE), np.uint64(inverse))]

    held = worker_cache("decontam:powers", dict)
    if n > len(held.get("up", ())):
        held["up"], held["down"] = make(1 << max(19, (n - 1).bit_length()))
    return held["up"], held["down"]


#: Blocks of scripts written without spaces: Thai, Lao, Burmese, Khmer, Tai, Han, kana, Yi and their extensions.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF),
            (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F),
            (0x20000, 0x3FFFD))
_PLAIN, _GAP, _SINGLE, _SINGLE_MARK, _MARK = range(5)


def _char_kinds() -> np.ndarray:
    """The part every code point has in words; ASCII ones are told apart later."""

    def make():
        kinds = np.full(sys.maxunicode + 1, _GAP, dtype=np.uint8)
        kinds[:128] = _PLAIN
        for code in range(128, sys.maxunicode + 1):
            c = unicodedata.category(chr(code))[0]
            if c in "LNM":
                kinds[code] = _MARK if c == "M" else _PLAIN
        for lo, hi in UNSPACED:
            part = kinds[lo:hi + 1]
            for code in range(lo, hi + 1):
                c = unicodedata.category(chr(code))
                part[code - lo] = {"L": _SINGLE, "M": _SINGLE_MARK}.get(c[0], _SINGLE if c == "Nl" else part[code - lo])
        return kinds

    return worker_cache("decontam:kinds", make)


def parted(text: str) -> str:
    """The text with spaces for non-ASCII characters that are no letters, digits or marks, and before and after every
    letter (with its marks) of an unspaced script."""
    if text.isascii():
        return text
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kinds = _char_kinds()[codes]
    if not ((kinds >= _GAP) & (kinds < _MARK)).any():
        return text
    before = np.concatenate([[_PLAIN], kinds[:-1]])
    cut = (kinds == _SINGLE) | (kinds == _PLAIN) & ((before == _SINGLE) | (before == _SINGLE_MARK))
    out = np.full(len(codes) + int(cut.sum()), 32, dtype="<u4")
    out[np.arange(len(codes)) + np.cumsum(cut)] = np.where(kinds == _GAP, 32, codes)
    return out.tobytes().decode("utf-32-le")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the number of words of each text.

    Words are runs of letters, digits and marks of the lower-cased text; a letter of an unspaced script is a word.
    """
    raw = [parted((t or "").lower()).encode("utf-8") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    inside = (data >= 128) | (data >= 97) & (data <= 122) | (data >= 48) & (data <= 57)
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = turn[::2], turn[1::2]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
        h = (total[end] - total[begin]) * down[begin]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
    edges = np.cumsum([1] + [len(b) + 1 for b in raw])
    return h, np.diff(np.searchsorted(begin, edges))


def walk_plan(walks: int = WALKS, steps: int = STEPS, sampled: int = SAMPLED, gap: int = GAP, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per walk: an odd multiplier for each step, whose top product bit moves the pointer, and the sampled steps."""
    rng = np.random.default_rng(seed)
    plan = []
    for _ in range(walks):
        moves = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Neighbouring steps often copy the same word, so sampled steps keep a distance of ``gap`` at least.
        places = np.sort(rng.choice(steps - (gap - 1) * (sampled - 1), sampled, replace=False)) + (gap - 1) * np.arange(sampled)
        plan.append((moves, places))
    return plan


def walk_keys(words: np.ndarray, last: np.ndarray, starts: np.ndarray, moves: np.ndarray, places: np.ndarray) -> np.ndarray:
    """LSH key of the window at each start; past the last word of its text a walk copies 0."""
    at = starts.copy()
    key = np.zeros(len(starts), dtype=np.uint64)
    sampled = set(places.tolist())
    with np.errstate(over="ignore"):
        for step in range(places[-1] + 1):
            w = np.where(at < last, words[np.minimum(at, len(words) - 1)], np.uint64(0))
            if step in sampled:
                key = (key ^ w) * _MIX
                key ^= key >> np.uint64(31)
            at += ((w * moves[step]) >> np.uint64(63)).astype(np.int64)
    return key


def sequence_keys(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A key of the ``n`` words at each start."""
    key = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            key = (key ^ words[starts + k]) * _MIX
            key ^= key >> np.uint64(31)
    return key


def infix_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """``(edits, end)``: least word edits that turn the item into some stretch of ``words``, and where it ends."""
    steps = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in enumerate(item):
        nxt = row + 1
        np.minimum(nxt[1:], row[:-1] + (words != w), out=nxt[1:])
        row = np.minimum.accumulate(nxt - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


class ItemIndex:
    """Keys of every window of a block of benchmark items, for look-up in arrays; items of one text are one entry."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        same: dict[str, list[int]] = {}
        for i, t in zip(ids, texts):
            same.setdefault(t, []).append(i)
        words, counts = word_hashes(list(same))
        self.ids, self.words = list(same.values()), words
        self.end = np.cumsum(counts)
        self.begin = self.end - counts
        owner = np.repeat(np.arange(len(same)), counts)
        at = np.arange(len(words))
        size, rest = counts[owner], self.end[owner] - at
        # A window of fewer words than the smallest item says too little.
        long = at[(size >= SHORT_WORDS) & (rest >= MIN_WORDS)]
        short = at[(size >= MIN_WORDS) & (size < SHORT_WORDS) & (rest >= SHORT_WINDOW)]
        self.tables = []
        for windows, plan in ((long, walk_plan()), (short, walk_plan(SHORT_WALKS, SHORT_STEPS, SHORT_SAMPLED, SHORT_GAP, seed=12))):
            for moves, places in plan if len(windows) else ():
                key = walk_keys(words, self.end[owner[windows]], windows, moves, places)
                order = np.argsort(key, kind="stable")
                seen = np.zeros(1 << 20, dtype=bool)
                seen[(key & np.uint64(0xFFFFF)).astype(np.int64)] = True
                self.tables.append((moves, places, key[order], windows[order], owner[windows][order], seen))

        #: Word count -> sorted keys of the items of so few words, and the items.
        self.exact = {}
        for n in range(1, MIN_WORDS):
            few = np.flatnonzero(counts == n)
            if len(few):
                key = sequence_keys(words, self.begin[few], n)
                order = np.argsort(key, kind="stable")
                self.exact[n] = key[order], few[order]

    def sequences(self, words: np.ndarray, last: np.ndarray, owner: np.ndarray):
        """``(text number, item, first word)`` of the first place of each item of under ``MIN_WORDS`` words in each text."""
        for n, (keys, items) in self.exact.items():
            starts = np.flatnonzero(np.arange(len(words)) + n <= last)
            mine = sequence_keys(words, starts, n)
            lo, hi = (np.searchsorted(keys, mine, side=s) for s in ("left", "right"))
            met = np.flatnonzero(hi > lo)
            # Places of one text and key are in order: the first of each stays.
            _, first = np.unique(np.stack([owner[starts[met]], lo[met]]), axis=1, return_index=True)
            for k in met[np.sort(first)]:
                for item in items[lo[k]:hi[k]].tolist():
                    yield int(owner[starts[k]]), item, int(starts[k])

    def candidates(self, words: np.ndarray, last: np.ndarray, starts: np.ndarray):
        """``(start, item, offset)`` of the windows that share a key with an item's window, some ``HITS`` at a time."""
        for moves, places, keys, place, owner, seen in self.tables:
            mine = walk_keys(words, last, starts, moves, places)
            maybe = np.flatnonzero(seen[(mine & np.uint64(0xFFFFF)).astype(np.int64)])
            lo, hi = (np.searchsorted(keys, mine[maybe], side=s) for s in ("left", "right"))
            cuts = np.flatnonzero(np.diff(np.cumsum(hi - lo) // HITS)) + 1
            for windows, first, n in zip(*(np.split(x, cuts) for x in (maybe, lo, hi - lo))):
                row = np.repeat(windows, n)
                hit = np.repeat(first, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield starts[row], owner[hit], place[hit] - self.begin[owner[hit]]


def tallied(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of all parts with the sums of their counts."""
    rows, place = np.unique(np.concatenate([r for r, _ in parts], axis=1), axis=1, return_inverse=True)
    return rows, np.bincount(place.reshape(-1), np.concatenate([n for _, n in parts]), rows.shape[1])


def aligned_words(index: ItemIndex, words, begin, end, doc, item, diagonal, similarity: float) -> np.ndarray:
    """Candidates that can pass: enough item words stand in the document no further off the diagonal than edits move them."""
    mine = np.arange(len(doc))
    size = (index.end - index.begin)[item]
    room = (size * (1 - similarity) + 1e-9).astype(np.int64)
    moves = np.arange(-int(room.max(initial=0)), int(room.max(initial=0)) + 1)
    seen = np.zeros(len(mine), dtype=np.int64)
    for k in range(int(size.max(initial=0))):
        live = (k < size[mine]).nonzero()[0]
        c = mine[live]
        at = diagonal[c, None] + k + moves
        inside = (np.abs(moves) <= room[c, None]) & (at >= begin[doc[c], None]) & (at < end[doc[c], None])
        wanted = index.words[index.begin[item[c]] + k]
        seen[live] += (inside & (words[np.where(inside, at, 0)] == wanted[:, None])).any(axis=1)
        good = seen >= np.minimum(k + 1, size[mine]) - room[mine]
        mine, seen = mine[good], seen[good]
    return mine


def search_group(index: ItemIndex, texts: list[str | None], similarity: float, stride: int):
    """``(text number, item id, similarity, first word, words)`` of the items found in a group of texts."""
    words, counts = word_hashes(texts)
    if not len(words):
        return
    end = np.cumsum(counts)
    begin = end - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    for doc, it, first in index.sequences(words, end[owner], owner):
        for i in index.ids[it]:
            yield doc, i, 1.0, first - int(begin[doc]), int(index.end[it] - index.begin[it])
    if not index.tables:
        return
    starts = np.flatnonzero((np.arange(len(words)) - begin[owner]) % stride == 0)
    # Windows of one item on one diagonal are one candidate; the diagonal with most windows is tried first.
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for start, item, offset in index.candidates(words, end[owner[starts]], starts):
        held.append((np.stack([owner[start], item, start - offset]), np.ones(len(start))))
        if sum(len(n) for _, n in held[1:]) > HITS:
            held = [tallied(held)]
    rows, tally = tallied(held)
    if not len(tally):
        return
    widest = 2 * int((index.end - index.begin)[rows[1]].max() * (1 - similarity) + 1e-9) + 1
    step = max(1, CELLS // widest)
    keep = np.concatenate([k + aligned_words(index, words, begin, end, *rows[:, k:k + step], similarity)
                           for k in range(0, len(tally), step)])
    rows, tally = rows[:, keep], tally[keep]
    done: set[tuple[int, int]] = set()
    tried: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k in np.lexsort((rows[2], -tally)):
        doc, it, diagonal = (int(x) for x in rows[:, k])
        if (doc, it) in done:
            continue
        wanted = index.words[index.begin[it]:index.end[it]]
        n = len(wanted)
        room = int(n * (1 - similarity) + 1e-9)
        lo, hi = max(int(begin[doc]), diagonal - 2 * room), min(int(end[doc]), diagonal + n + 2 * room)
        # A stretch that was tried as a whole needs no second try.
        if any(a <= lo and hi <= b for a, b in tried.get((doc, it), ())):
            continue
        tried.setdefault((doc, it), []).append((lo, hi))
        part = words[lo:hi]
        edits, stop = infix_distance(wanted, part)
        if edits <= room:
            # The same search backwards from the end finds the beginning.
            _, back = infix_distance(wanted[::-1], part[:stop][::-1])
            done.add((doc, it))
            for i in index.ids[it]:
                yield doc, i, 1 - edits / n, lo + stop - back - int(begin[doc]), back


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, stride: int = STRIDE,
                 id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: every benchmark item found in every whole document.

    Similarity is one less the word edits over the item's words. Items go through memory in blocks of bounded size,
    each in a pass of its own over the documents; nothing of a document leaves its task but its hits. Null texts and
    ids on either side, empty tables and items without words give no rows; repeated rows give repeated hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).dropna())
    found = []
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast((mine["item_id"].tolist(), mine["text"].tolist()))
        found.append(rows.mapInArrow(_search(sent, similarity, stride),
                                     "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint"))
    return reduce(DataFrame.unionAll, found)


def _search(sent, similarity: float, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(*sent.value)
        names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = [len(x.as_buffer()) for x in texts]
            at = 0
            while at < len(ids):
                stop, total = at + 1, sizes[at]
                while stop < len(ids) and total + sizes[stop] <= GROUP_BYTES:
                    total += sizes[stop]
                    stop += 1
                hits = [(ids[at + d], *rest) for d, *rest in search_group(index, texts[at:stop].to_pylist(), similarity, stride)]
                if hits:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*hits), kinds)], names=names)
                at = stop

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
          stride: int = STRIDE, item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark item is found, with their columns; rows without an id are kept.

    While the items fit one block, documents pass through the search and are filtered there, without a join. Beyond that
    the hits of all blocks are joined by id and text, so rows that share an id are judged one by one.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > block_bytes:
        key = F.xxhash64(F.col(text))
        hits = contaminated(docs.filter(F.col(id_col).isNotNull()).select(key.alias("doc_id"), F.col(text).alias("text")), benchmark, similarity,
                            stride, item_col=item_col, item_text=item_text, block_bytes=block_bytes)
        hit = hits.select(F.col("doc_id").alias("__hit")).distinct()
        return docs.join(hit, F.col(id_col).isNotNull() & (key == F.col("__hit")), "left_anti")
    mine = items.toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((mine["item_id"].tolist(), mine["text"].tolist()))
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("decontam:")
        index = ItemIndex(*sent.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at_text)), 0).to_pylist()
            at = 0
            while at < batch.num_rows:
                stop, total = at + 1, sizes[at]
                while stop < batch.num_rows and total + sizes[stop] <= GROUP_BYTES:
                    total += sizes[stop]
                    stop += 1
                rows = batch.slice(at, stop - at)
                known, texts = rows.column(at_id).is_valid().to_pylist(), rows.column(at_text).to_pylist()
                searched = [i for i, (k, t) in enumerate(zip(known, texts)) if k and t is not None]
                keep = np.ones(len(texts), dtype=bool)
                for d, *_ in search_group(index, [texts[i] for i in searched], similarity, stride):
                    keep[searched[d]] = False
                yield rows.filter(pa.array(keep))
                at = stop
        # The powers grow with the largest group; later stages in this worker have no use for them.
        worker_cache("decontam:powers", dict).clear()
        give_back()

    return spread(docs).mapInArrow(run, docs.schema)
