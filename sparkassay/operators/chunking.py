"""Chunking operators: each document row becomes its chunk rows.

A document's chunks are built inside its own row and exploded, so no operator here shuffles and the chunk number
is the array position rather than a window over the exploded rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.text import is_blank, lines, sentences, strip

# Steps handled per text block: a substring scans from the start of its input, so very long texts are first cut
# into blocks and the windows are taken inside a block.
BLOCK_STEPS = 64


def _explode_chunks(df: DataFrame, chunks: Column, drop: list[str]) -> DataFrame:
    keep = [c for c in df.columns if c not in drop]
    out = df.select(*keep, F.posexplode(chunks).alias("chunk_index", "_c"))
    return out.select(*keep, "chunk_index", "_c.*")


def chunk_fixed(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; blank windows drop out before numbering."""
    if overlap >= size:
        raise ValueError("overlap must be less than the chunk size")
    step = size - overlap
    block = step * BLOCK_STEPS
    total = F.length(text)
    starts = lambda stop: F.when(stop > 0, F.sequence(F.lit(0), stop - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    block_starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(block))).otherwise(
        F.array().cast("array<int>"))
    blocks = F.transform(block_starts, lambda b: F.struct(
        b.alias("at"), F.substring(F.col(text), b + 1, F.lit(block - step + size)).alias("body")))
    windows = F.flatten(F.transform(blocks, lambda b: F.transform(
        starts(F.least(F.lit(block), total - b["at"])),
        lambda o: F.struct(
            strip(F.substring(b["body"], o + 1, F.lit(size))).alias("text"),
            (b["at"] + o).alias("start_char"),
            F.least(b["at"] + o + size, total).alias("end_char")))))
    out = _explode_chunks(df, F.filter(windows, lambda w: w["text"] != ""), [text])
    return out.withColumn("strategy", F.lit("fixed_size"))


def split_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(sentences(text)).alias("sentence_index", "sentence"))


def _pack(lengths, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing of sentence lengths into (first, count) runs."""
    runs, first, size = [], 0, 0
    for i, n in enumerate(lengths):
        if i > first and size + n + 1 > max_size:
            runs.append((first, i - first))
            first = max(first, i - overlap)
            size = int(sum(lengths[first:i]))
        size += n + 1
    if len(lengths) > first:
        runs.append((first, len(lengths) - first))
    return runs


def _packer(max_size: int, overlap: int):
    @F.pandas_udf("array<struct<first:int,n:int>>")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lengths in batches:
            yield lengths.map(lambda v: [{"first": a, "n": b} for a, b in _pack(list(v), max_size, overlap)])

    return pack


def chunk_sentence(df: DataFrame, text: str = "text", max_size: int = 512, overlap: int = 1) -> DataFrame:
    """Greedy runs of whole sentences up to ``max_size``, carrying the last ``overlap`` sentences over.

    Only sentence lengths travel to Python (packing is a sequential fold that stays linear there); splitting and
    joining the text happen in the JVM.
    """
    split = df.withColumn("_s", sentences(text)).drop(text)
    runs = split.withColumn("_r", _packer(max_size, overlap)(F.coalesce(F.transform("_s", F.length), F.array().cast("array<int>"))))
    chunks = F.transform("_r", lambda r: F.struct(
        F.array_join(F.slice("_s", r["first"] + 1, r["n"]), " ").alias("text"),
        r["n"].alias("sentence_count")))
    return _explode_chunks(runs, chunks, ["_s", "_r"]).withColumn("strategy", F.lit("sentence"))


def chunk_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One chunk per non-blank line, numbered by its line in the original text."""
    keep = [c for c in df.columns if c != text]
    out = df.select(*keep, F.posexplode(lines(text)).alias("chunk_index", "_line"))
    return (out.select(*keep, "chunk_index", strip("_line").alias("text"))
            .filter(F.col("text") != "").withColumn("strategy", F.lit("schema")))


CHUNKERS = {"fixed": chunk_fixed, "sentence": chunk_sentence, "schema": chunk_lines}


def index_documents(df: DataFrame, chunker: str = "sentence", metadata: str | None = None, **options) -> DataFrame:
    """Skip blank documents, chunk the rest, fold chunk facts into the inherited metadata map."""
    if chunker not in CHUNKERS:
        raise ValueError(f"unknown chunker {chunker!r}; choose one of {sorted(CHUNKERS)}")
    chunks = CHUNKERS[chunker](df.filter(~is_blank("text")), **options)
    if metadata is None:
        return chunks
    facts = [c for c in ("chunk_index", "start_char", "end_char", "sentence_count", "strategy") if c in chunks.columns]
    own = F.create_map(*[x for c in facts for x in (F.lit(c), F.col(c).cast("string"))])
    inherited = F.map_filter(metadata, lambda k, _: ~k.isin(facts))
    return chunks.withColumn(metadata, F.map_concat(inherited, own))
