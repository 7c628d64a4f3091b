"""Token-id files in patched frame-of-reference blocks.

A file is a run of segments; a segment holds whole documents and is self-describing::

    magic 'PFR1' | n_docs u32 | n_ids u32 | n_blocks u32
    doc_id i64 x n_docs | null-id flag u8 x n_docs | n_tokens u32 x n_docs
    base u32 x n_blocks | width u8 x n_blocks | n_exceptions u8 x n_blocks | block start u32 x n_blocks
    body: per block the packed low bits (16 bytes per bit of width), exception places (u8) and values (u32)
    line feed

A block holds 128 ids less the block's smallest. The width is the bit length of a percentile of these
differences; larger ones are exceptions, kept in full in the block's exception list. All numbers are
little-endian. The start table gives direct access to any block of a segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkassay.llm.wordids import word_encoder
from sparkassay.llm.worker import forget_others, give_back
from sparkassay.session import materialize, scratch_path

BLOCK = 128
#: Ids after which a segment is closed; a longer document makes one longer segment.
SEGMENT_IDS = 1 << 18
#: Segments per file, so that a reader holds about 20 MB at a time.
SEGMENTS_PER_FILE = 32
#: Share of a block's differences that must fit the packed width.
PERCENTILE = 0.9
#: Blocks packed or unpacked at a time inside a task.
SLICE = 1024

_HEAD = "<4sIII"


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE):
    """``(base, width, n_exceptions, start, body)`` of an id array; the last block is filled up with its own minimum."""
    n_blocks = -(-len(ids) // BLOCK)
    whole = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    whole[:len(ids)] = ids
    if len(whole) > len(ids):
        whole[len(ids):] = ids[(n_blocks - 1) * BLOCK:].min()
    whole = whole.reshape(n_blocks, BLOCK)
    base = whole.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = whole - base[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile)) - 1))
    pick = np.partition(diff, at, axis=1)[:, at] if n_blocks else base
    width = np.ceil(np.log2(pick.astype(np.float64) + 1)).astype(np.uint8)
    odd = (diff >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0) & (width < 32)[:, None]
    n_exc = odd.sum(axis=1).astype(np.uint8)
    size = 16 * width.astype(np.int64) + 5 * n_exc
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(int(start[-1]), dtype=np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        for k in range(0, len(rows) if w else 0, SLICE):
            part = rows[k:k + SLICE]
            bits = np.unpackbits(diff[part].astype("<u4").view(np.uint8).reshape(len(part), BLOCK, 4), axis=2, bitorder="little")
            bits = np.ascontiguousarray(bits[:, :, :w]).reshape(len(part), -1)
            body[start[part][:, None] + np.arange(16 * int(w))] = np.packbits(bits, axis=1, bitorder="little")
    block, place = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exc, dtype=np.int64) - n_exc, n_exc)
    places_at = start[block] + 16 * width[block].astype(np.int64)
    body[places_at + nth] = place
    values = diff[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(places_at + n_exc[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return base, width, n_exc, start[:-1].astype(np.uint32), body.tobytes()


def unpack_blocks(base, width, n_exc, start, body: bytes, n_ids: int) -> np.ndarray:
    """The ids back, as unsigned 32-bit integers."""
    raw = np.frombuffer(body, dtype=np.uint8)
    start, n_exc, wide = start.astype(np.int64), n_exc.astype(np.int64), width.astype(np.int64)
    diff = np.zeros((len(base), BLOCK), dtype=np.uint32)
    for w in np.unique(wide):
        rows = np.flatnonzero(wide == w)
        first = np.arange(BLOCK) * w
        for k in range(0, len(rows) if w else 0, SLICE):
            part = rows[k:k + SLICE]
            # A number of up to 32 bits lies in the five bytes from the one that holds its first bit.
            found = np.zeros((len(part), BLOCK), dtype=np.uint64)
            for byte in range((int(w) + 14) // 8):
                found |= raw[np.minimum(start[part][:, None] + (first >> 3) + byte, len(raw) - 1)].astype(np.uint64) << np.uint64(8 * byte)
            diff[part] = (found >> (first & 7).astype(np.uint64)) & np.uint64((1 << int(w)) - 1)
    block = np.repeat(np.arange(len(base)), n_exc)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    places_at = start[block] + 16 * wide[block]
    values = raw[(places_at + n_exc[block] + 4 * nth)[:, None] + np.arange(4)]
    diff[block, raw[places_at + nth]] = np.ascontiguousarray(values).view("<u4").ravel()
    return (diff + base[:, None]).ravel()[:n_ids]


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A segment but for its closing line feed, which the file writer adds."""
    lengths = np.array([len(b) // 4 for b in ids], dtype="<u4")
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    base, width, n_exc, start, body = pack_blocks(flat)
    return b"".join([
        struct.pack(_HEAD, b"PFR1", len(ids), len(flat), len(base)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), bytes(d is None for d in doc_ids), lengths.tobytes(),
        base.astype("<u4").tobytes(), width.tobytes(), n_exc.tobytes(), start.astype("<u4").tobytes(), body])


def read_segments(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """``(doc_ids, n_tokens, ids)`` of each segment of a file, in file order."""
    at = 0
    while at < len(content):
        magic, n_docs, n_ids, n_blocks = struct.unpack_from(_HEAD, content, at)
        if magic != b"PFR1":
            raise ValueError(f"no segment at byte {at}")
        at += struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        doc_ids, no_id, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        base, width, n_exc, start = take("<u4", n_blocks), take("u1", n_blocks), take("u1", n_blocks), take("<u4", n_blocks)
        size = int(start[-1]) + 16 * int(width[-1]) + 5 * int(n_exc[-1]) if n_blocks else 0
        ids = unpack_blocks(base, width, n_exc, start, content[at:at + size], n_ids)
        at += size + 1
        yield [None if x else int(d) for d, x in zip(doc_ids, no_id)], lengths, ids


def write_token_files(docs: DataFrame, vocab: str, end_id: int = 2, path: str | None = None,
                      id_col: str = "doc_id", text: str = "text") -> str:
    """Encode whole texts, append ``end_id`` to each and write the files in ascending id order; returns the folder.

    A null or empty text is its end id alone; null ids come first, repeated rows are kept, other columns are
    ignored. The only shuffle ranges the raw rows by id. File names sort as the ids do, and the files go
    through Spark's own writer, so a lost executor's files are written again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(vocab), struct.pack("<I", end_id)
        keys: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def close():
            segment = pa.record_batch([pa.array([write_segment(keys, held)], pa.binary())], names=["segment"])
            keys.clear()
            held.clear()
            return segment

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                held.append(encode(t.as_py()) + end)
                n += len(held[-1]) // 4
                if n >= SEGMENT_IDS:
                    yield close()
                    n = 0
        if keys:
            yield close()
        give_back()

    path = path or scratch_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    segments = ordered.mapInArrow(run, "segment binary").select(F.col("segment").cast("string"))
    segments.write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path)
    return path


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row per stored document: ``file, nth`` (place in its file), ``doc_id, local_start, n_tokens, ids``.

    ``ids`` are little-endian unsigned 32-bit integers; with ``digest`` their checksum ``ids_crc32`` is given in their place,
    taken by the process that unpacks them. A task holds one file at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Reading needs no words; what the writing stage remembered would be held beside the files.
        forget_others("pfor")
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                nth = seen = 0
                for doc_ids, lengths, ids in read_segments(content):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    begins = ends - lengths
                    data = memoryview(ids.astype("<u4").tobytes())
                    stored = [data[4 * b:4 * e] for b, e in zip(begins, ends)]
                    last = pa.array([zlib.crc32(x) for x in stored], pa.int64()) if digest else pa.array(stored, pa.binary())
                    yield pa.record_batch([
                        pa.array([name] * len(doc_ids)), pa.array(np.arange(nth, nth + len(doc_ids))),
                        pa.array(doc_ids, pa.int64()), pa.array(begins + seen), pa.array(lengths.astype(np.int64)), last],
                        names=names)
                    nth += len(doc_ids)
                    seen += int(ends[-1])
                del content
                give_back()

    names = ["file", "nth", "doc_id", "local_start", "n_tokens", "ids_crc32" if digest else "ids"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    named = files.filter("length > 0").select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    return named.mapInArrow(run, "file string, nth bigint, doc_id bigint, local_start bigint, n_tokens bigint, "
                                 + ("ids_crc32 bigint" if digest else "ids binary"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files.

    ``start`` adds the ids of all earlier files, one small row per file, to the start inside the file.
    """

    docs = materialize(read_token_files(spark, path, digest=True).drop("nth"), "token-index")
    # part-<partition>-<uuid>-c<chunk>: both numbers are zero-filled, the uuid is the same in one write.
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return docs.join(files.select("file", "before"), "file").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
