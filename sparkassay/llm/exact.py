"""Exact duplicates by two passes over Bloom filters.

The first pass reads only digests. Every task keeps two filters: one of all digests it has seen and one of those it has
seen before. Tasks' filters meet segment by segment: a bit that two tasks set goes to the second filter. The second pass
looks every digest up in the second filter; rows not in it are certainly single and go straight to the result, only the
others shuffle, by their whole digest, so a false positive costs a shuffled row and never a wrong answer.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.operators.relational import top_per_group
from sparkassay.session import materialize

#: Bits of a filter per row, and bits set per digest.
BITS_PER_ROW, PROBES = 16, 3
#: Smallest and largest filter in bits. The largest (32 MB) bounds what is broadcast and what a task holds; with more
#: rows than it was made for, more of them shuffle and the result stays the same.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bytes of a filter that are merged as one row.
SEGMENT = 1 << 16
#: Groups with more than 1 / HOT_GROUPS of the repeated rows are joined by broadcast: fewer than so many can exist.
HOT_GROUPS = 20_000


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased, as bytes; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(plain, 256))


class Bloom:
    """A filter over 64-bit hashes; the number of bits is a power of two."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.mask = np.uint64(bits - 1)
        self.cells = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) & self.mask for i in range(PROBES)])

    def add(self, hashes: np.ndarray) -> None:
        at = np.unique(self._places(hashes))
        if not len(at):
            return
        cell = (at >> np.uint64(3)).astype(np.int64)
        bit = np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.cells[cell[first]] |= np.bitwise_or.reduceat(bit, first)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self._places(hashes)
        found = self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
        return (found & 1).all(axis=0)


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * max(1, rows) - 1).bit_length()))


def _hashes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def repeated_filter(digests: DataFrame, bits: int) -> bytes:
    """The filter of all digests that may occur more than once; ``digests`` has the binary column ``digest``.

    Every digest that occurs twice is in it: inside a task by look-up, across tasks since both set all its bits.
    """

    def sight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            hashes, counts = np.unique(_hashes(batch.column(0)), return_counts=True)
            twice.add(hashes[(counts > 1) | once.holds(hashes)])
            once.add(hashes)
        for s in range(0, len(once.cells), SEGMENT):
            a, b = once.cells[s:s + SEGMENT], twice.cells[s:s + SEGMENT]
            if a.any():
                yield pa.record_batch([pa.array([s // SEGMENT], pa.int32()), pa.array([a.tobytes()]), pa.array([b.tobytes()])],
                                      names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def close():
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([twice.tobytes()])], names=["segment", "twice"])

        for batch in batches:
            for segment, a, b in zip(*[c.to_pylist() for c in batch.columns]):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if segment == now:
                    twice |= b | (once & a)
                    once |= a
                    continue
                if now is not None:
                    yield close()
                now, once, twice = segment, a.copy(), b.copy()
        if now is not None:
            yield close()

    seen = digests.select(F.xxhash64("digest").alias("h")).mapInArrow(sight, "segment int, once binary, twice binary")
    merged = seen.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    # At most MOST_BITS / 8 bytes in all.
    for row in merged.collect():
        part = np.frombuffer(row["twice"], np.uint8)
        whole[row["segment"] * SEGMENT:row["segment"] * SEGMENT + len(part)] = part
    return whole.tobytes()


def flag_repeated(rows: DataFrame, digest: str, data: bytes, flag: str) -> DataFrame:
    """``rows`` with a boolean column ``flag``: false only if no other row can have this digest. No shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(data)
    n = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(len(held.value) * 8, held.value)
        for batch in batches:
            found = bloom.holds(_hashes(batch.column(n)))
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(found)], names=[f"c{i}" for i in range(n + 1)])

    # Columns go by place, so that any names, repeated ones too, are kept.
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema.fields)]
    found = rows.select("*", F.xxhash64(digest)).mapInArrow(run, T.StructType([*fields, T.StructField(f"c{n}", T.BooleanType())]))
    return found.toDF(*rows.columns, flag)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after lower-casing A-Z; null counts as empty, and texts are never cut. Of
    equal texts the row with the largest id stays; a null id is smaller than any other, and of rows that repeat the
    largest id one stays. Other columns are ignored and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(F.col(text)).alias("digest"))
    # Stored once: texts are read one time only, and row numbers stay as they are when a task is repeated.
    digests = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    repeated = repeated_filter(digests, filter_bits(digests.count()))
    flagged = flag_repeated(digests, "digest", repeated, "maybe")
    single = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "digest")

    maybe = materialize(flagged.filter("maybe").drop("maybe"), "maybe-repeated")
    groups = materialize(maybe.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")), "groups")
    floor = maybe.count() / HOT_GROUPS
    hot = F.broadcast(groups.filter(F.col("group_size") > floor))
    cold = groups.filter(F.col("group_size") <= floor)
    joined = maybe.join(hot, "digest").unionByName(maybe.join(hot, "digest", "left_anti").join(cold, "digest"))
    grouped = joined.select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
                            (F.col("row") == F.col("top.row")).alias("kept"), "digest")
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that are certainly single are not shuffled; of the others each task sends at most one row per text. Of rows
    that repeat the largest id of equal texts, any one stays.
    """
    digest, flag = "__digest", "__maybe"
    rows = docs.withColumn(digest, text_digest(F.col(text)))
    repeated = repeated_filter(rows.select(F.col(digest).alias("digest")), filter_bits(docs.count()))
    flagged = flag_repeated(rows, digest, repeated, flag)
    best = top_per_group(flagged.filter(flag), [digest], [F.desc_nulls_last(id_col)], 1, "__place")
    return flagged.filter(~F.col(flag)).select(*docs.columns).unionByName(best.select(*docs.columns))
