"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees over Hamming distance.

Two fingerprints within r differing bits agree in at least one of r + 1 bit bands, so each band value is a shard of
its own: a BK-tree is built over the shard's distinct fingerprints and the same shard's fingerprints are looked up in
it. Handing every tree to every task would cost documents times documents; a tree travels only to the look-ups of its
band value. Shards of more than ``TREE_NODES`` fingerprints are dealt into several trees and look-up blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.components import components
from sparkassay.llm.worker import give_back, spread
from sparkassay.session import materialize

#: Fingerprints of one tree, and look-ups of one block.
TREE_NODES = 4096

_BYTE_LANES = 0x0101010101010101


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the 64-bit hashes.

    Bits are added eight at a time in the byte lanes of a word, 255 hashes before a lane could run over.
    """
    n = len(hashes)
    if n == 0:
        return 0
    blocks = np.zeros((-(-n // 255), 255), dtype=np.uint64)
    blocks.reshape(-1)[:n] = hashes
    out = 0
    lanes = np.uint64(_BYTE_LANES)
    for shift in range(8):
        sums = ((blocks >> np.uint64(shift)) & lanes).sum(axis=1, dtype=np.uint64)
        counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > n):
            out |= 1 << (8 * int(byte) + shift)
    return out


def text_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8").lower().split() if text else []
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)] if parts else []
    return fingerprint_of(np.array([xxh64_intdigest(s, seed) for s in shingles], dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: the signed 64-bit SimHash of each whole text over its word shingles, repeats included.

    ASCII letters are lower-cased and words end at ASCII white space. A text with fewer words than a shingle is one
    shingle; null and wordless texts have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([text_fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, fp bigint")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def build_tree(points: np.ndarray, bits: int = 64) -> np.ndarray:
    """BK-tree over distinct 64-bit points: ``child[node, distance]`` is the child at that distance, -1 if none.

    All points walk down together from the root, the first point; where several arrive at one free edge, the first
    becomes the child and the others walk on from it.
    """
    child = np.full((len(points), bits + 1), -1, dtype=np.int32)
    moving, at = np.arange(1, len(points)), np.zeros(max(0, len(points) - 1), dtype=np.int64)
    while len(moving):
        d = distances(points[moving], points[at])
        free = np.flatnonzero(child[at, d] < 0)
        _, first = np.unique(at[free] * (bits + 1) + d[free], return_index=True)
        placed = free[first]
        child[at[placed], d[placed]] = moving[placed]
        at = child[at, d].astype(np.int64)
        on = np.ones(len(moving), dtype=bool)
        on[placed] = False
        moving, at = moving[on], at[on]
    return child


def search_tree(child: np.ndarray, points: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, node)`` pairs within the radius, following only edges within the radius of the node's distance."""
    hit_q, hit_n = [], []
    q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
    edges = np.arange(-radius, radius + 1)
    last = child.shape[1] - 1
    while len(q):
        d = distances(queries[q], points[node])
        near = d <= radius
        hit_q.append(q[near])
        hit_n.append(node[near])
        want = d[:, None] + edges
        nxt = np.where((want >= 0) & (want <= last), child[node[:, None], np.clip(want, 0, last)], -1)
        row, col = np.nonzero(nxt >= 0)
        q, node = q[row], nxt[row, col].astype(np.int64)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(hit_q), np.concatenate(hit_n)) if hit_q else (none, none)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member reachable for each of ``n`` numbers linked by the pairs ``a, b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def link_cell(tree_points: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links ``(fp, fp)`` of one tree and one look-up block: the same components as all their close pairs."""
    q, node = search_tree(build_tree(tree_points), tree_points, queries, radius)
    values, place = np.unique(np.concatenate([queries[q], tree_points[node]]), return_inverse=True)
    root = spanning(len(values), place[:len(q)], place[len(q):])
    linked = np.flatnonzero(root != np.arange(len(values)))
    return values[linked], values[root[linked]]


def close_links(distinct: DataFrame, radius: int = 2, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) whose components are those of all pairs within the radius.

    Cells are (band, value, tree, block) with tree <= block; a member goes to its own tree's cells and, as a look-up,
    to those of the trees before it. Each cell is sorted together and worked on alone, with two times ``tree_nodes``
    fingerprints at most on average.
    """
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("value"))
                      for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    rows = materialize(distinct.select("fp", F.explode(bands).alias("_k")).select("fp", "_k.band", "_k.value"), "bands")
    shards = materialize(rows.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shards")
    parts = F.ceil(F.col("n") / tree_nodes).cast("int")
    mine = rows.join(shards, ["band", "value"]).withColumn("_t", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    cells = F.when(parts == 1, F.array(F.struct(F.lit(0).alias("tree"), F.lit(0).alias("block"), F.lit(3).alias("role")))).otherwise(
        F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(
            F.least(F.col("_t"), o).alias("tree"), F.greatest(F.col("_t"), o).alias("block"),
            F.when(o == F.col("_t"), 3).when(F.col("_t") < o, 1).otherwise(2).alias("role"))))
    key = ["band", "value", "tree", "block"]
    dealt = mine.select("fp", "band", "value", F.explode(cells).alias("_c")).select(
        F.xxhash64("band", "value", "_c.tree", "_c.block").alias("cell"), "_c.role", "fp", "band", "value", "_c.tree", "_c.block")
    # A fixed number of parts: the rows are few bytes but much work.
    parts_wanted = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts_wanted, *key).sortWithinPartitions(*key, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def links():
            rows = np.concatenate(held, axis=1)
            role, fp = rows[0], rows[1].view(np.uint64)
            a, b = link_cell(fp[role & 1 > 0], fp[role & 2 > 0], radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key])
            data = np.stack([batch.column("role").to_numpy().astype(np.int64), batch.column("fp").to_numpy()])
            edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edge], [*edge, batch.num_rows]):
                k = tuple(keys[:, lo])
                if now is not None and k != now:
                    yield links()
                    held.clear()
                now = k
                held.append(data[:, lo:hi])
        if held:
            yield links()
        held.clear()
        give_back()

    return ordered.select("role", "fp", *key).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable), a row per document.

    Equal fingerprints are one node, whatever their number, so exact copies never meet as pairs. Null ids keep their
    row and never name a component unless all of its ids are null; repeated rows are kept; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, words, id_col=id_col, text=text), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = components(materialize(close_links(nodes.select("fp"), radius), "close-links"))
    placed = nodes.join(labels, nodes.fp == labels.node, "left").select(
        nodes.fp, "first", F.coalesce("component", "fp").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(placed.join(lowest, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
