"""Near-duplicates by the Jaccard similarity of five-word shingles: SimHash trees and MinHash bands propose, exact sets decide.

Texts whose SimHash fingerprints differ in at most two bits are linked through the BK-trees of ``simhash``. A fingerprint
of two texts at Jaccard 0.8 differs in about ten bits and often in fifteen, and no band of a fingerprint is selective at
such a radius, so MinHash bands add the pairs beyond two bits: they meet two texts of similarity s in some band with
probability 1 - (1 - s**ROWS)**BANDS, 0.9996 at 0.8. Only documents of a pair that met send their shingles through a shuffle, and
a pair is a link only if its sets have the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm import simhash
from sparkassay.llm.components import components
from sparkassay.llm.decontam import parted
from sparkassay.llm.worker import forget_others, give_back, spread
from sparkassay.operators.relational import broadcast_if_small
from sparkassay.session import materialize

WORDS, SIMILARITY = 5, 0.8
#: Bands of a sketch and minima in each.
BANDS, ROWS = 20, 5
#: Shingles hashed at a time.
CHUNK = 4096
#: Members of a cell in one block, and ids that are sent to where texts are read; with more, texts move to the ids.
CELL_BLOCK = 256
WANTED_ROWS = 1_000_000


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, a wordless one none.

    ASCII letters are lower-cased and words end at ASCII white space, as in ``simhash.fingerprints``. In texts with letters
    of scripts written without spaces each such letter is a word, and other non-ASCII signs part words.
    """
    from xxhash import xxh64_intdigest

    parts = parted(text or "").encode("utf-8").lower().split()
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else \
        [b" ".join(parts)] if parts else []
    return np.unique(np.array([xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band of the MinHash sketch of a set of hashes."""
    if not len(hashes):
        return np.zeros(bands, dtype=np.int64)
    factors = np.random.default_rng(5).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    key = np.zeros(bands, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), CHUNK):
            np.minimum(low, (factors[:, None] * hashes[k:k + CHUNK]).min(axis=1), out=low)
        for minima in low.reshape(bands, rows).T:
            key = (key ^ minima) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, mark, digest, bands, fp``: a hash of the text, a digest of the whole shingle set, the band keys and the SimHash, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        forget_others("jaccard:")
        for batch in batches:
            digests, keys, fps = [], [], []
            for t in batch.column(2).to_pylist():
                hashes = shingle_hashes(t, words)
                digests.append(xxh3_128_digest(hashes.tobytes()))
                keys.append(band_keys(hashes))
                fps.append(simhash.text_fingerprint(t))
            yield pa.record_batch([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                                   pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "mark", "digest", "bands", "fp"])
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id bigint, mark bigint, digest binary, bands array<bigint>, fp bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text: str, words: int = WORDS) -> DataFrame:
    """``node, size, shingles`` for the wanted nodes, which name a text by ``doc_id`` and ``mark``; only their texts are read out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), words).view(np.int64) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                  names=["node", "size", "shingles"])
        give_back()

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    found = texts.join(broadcast_if_small(wanted, WANTED_ROWS), ["doc_id", "mark"]).select("node", "text")
    # A row that repeats a wanted one gives the same set again.
    return materialize(found.mapInArrow(run, "node bigint, size bigint, shingles array<bigint>").dropDuplicates(["node"]), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets have the wanted Jaccard similarity; sizes too far apart are told before sets move."""
    left, right = (sets.select(F.col("node").alias(c), F.col("size").alias(f"_n{c}"), F.col("shingles").alias(f"_{c}")) for c in ("a", "b"))
    sized = pairs.join(left.drop("_a"), "a").join(right.drop("_b"), "b")
    close = sized.filter(F.least("_na", "_nb") >= F.greatest("_na", "_nb") * similarity - 1e-9).select("a", "b")
    both = F.size(F.array_intersect("_a", "_b"))
    enough = both >= (F.col("_na") + F.col("_nb") - both) * similarity - 1e-9
    return close.join(left, "a").join(right, "b").filter(enough).select("a", "b")


def unlinked_members(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = CELL_BLOCK) -> DataFrame:
    """Links ``a, b`` between members of a cell that are in different groups yet; ``members`` is ``band, key, node, group, bands``.

    Members of a cell are packed in blocks and every two blocks of a cell meet in one task, which gives only links: no
    row is made for a pair. Two members that share several cells are compared in the first of them alone.
    """
    cell = members.groupBy("band", "key").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi"), F.count("*").alias("_n"))
    open_cells = cell.filter("_lo <> _hi").select("band", "key", F.floor((F.col("_n") - 1) / block + 1).cast("bigint").alias("_splits"))
    rows = members.join(open_cells, ["band", "key"]).withColumn("_split", F.pmod(F.xxhash64("node"), F.col("_splits"))).drop("_splits")
    rows = rows.join(sets, "node").repartition("band", "key", "_split").sortWithinPartitions("band", "key", "_split")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def close():
            table = pa.Table.from_batches(held).combine_chunks().select(["node", "group", "bands", "shingles"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            kinds = (pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([v], kind) for v, kind in zip(now, kinds)] + [pa.array([sink.getvalue().to_pybytes()])],
                                   names=["band", "key", "split", "members"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("band", "key", "_split")]))
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(starts, starts[1:]):
                if keys[a] != now and held:
                    yield close()
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(data: bytes):
            table = pa.ipc.open_stream(data).read_all().combine_chunks()
            node, group, bands, sets = (table.column(c).combine_chunks() for c in range(4))
            return (node.to_numpy(), group.to_numpy(), bands.flatten().to_numpy().reshape(len(node), -1),
                    sets.flatten().to_numpy(), sets.value_lengths().to_numpy())

        for batch in batches:
            left, right = [], []
            for band, same, one, other in zip(*[c.to_pylist() for c in batch.columns]):
                node, group, bands, flat, size = opened(one)
                node_b, group_b, bands_b, flat_b, size_b = opened(other)
                order = np.argsort(flat_b, kind="stable")
                owner, flat_b = np.repeat(np.arange(len(node_b)), size_b)[order], flat_b[order]
                begin = np.cumsum(size) - size
                for i in range(len(node)):
                    least, most = size[i] * similarity - 1e-9, size[i] / similarity + 1e-9
                    fit = (group_b != group[i]) & (size_b >= least) & (size_b <= most)
                    if same:
                        fit &= node_b > node[i]
                    if band:
                        fit &= ~(bands_b[:, :band] == bands[i, :band]).any(axis=1)
                    if not fit.any():
                        continue
                    mine = flat[begin[i]:begin[i] + size[i]]
                    lo, hi = np.searchsorted(flat_b, mine, "left"), np.searchsorted(flat_b, mine, "right")
                    n = hi - lo
                    hit = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    both = np.bincount(owner[hit], minlength=len(node_b))
                    linked = fit & (both >= (size[i] + size_b - both) * similarity - 1e-9)
                    left += [int(node[i])] * int(linked.sum())
                    right += node_b[linked].tolist()
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        give_back()

    packed = materialize(rows.mapInArrow(pack, "band int, key bigint, split bigint, members binary"), "cell-blocks")
    one, other = (packed.select("band", "key", F.col("split").alias(f"_s{c}"), F.col("members").alias(f"_m{c}")) for c in "ab")
    met = one.join(other, ["band", "key"]).filter("_sa <= _sb").select("band", (F.col("_sa") == F.col("_sb")).alias("same"), "_ma", "_mb")
    return met.mapInArrow(compare, "a bigint, b bigint")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes (``node, fp``) that reach all nodes linked over fingerprints of at most two differing bits.

    Nodes of one fingerprint are paired with the smallest of them, so copies never meet as pairs.
    """
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    equal = prints.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, other = (first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in "ab")
    near = simhash.close_links(first.select("fp")).join(one, "a").join(other, "b").filter("_a <> _b").select(
        F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return equal.unionByName(near)


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """``doc_id, mark, n, group``: every distinct row of id and text with its number of rows and its group; ids must not be null.

    Texts of equal shingle sets are one node. Nodes meet over their fingerprints, and the members of a band's cell first
    meet its smallest node only, then each other where they are not linked yet.
    """
    rows = materialize(sketches(docs, id_col, text, words).groupBy("digest", "doc_id", "mark").agg(
        F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "sketches")
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("_t"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("digest", "_t.*", "bands").withColumn("node", F.monotonically_increasing_id()), "nodes")
    cells = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = cells.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.max("node").alias("_m")).filter("pivot < _m").drop("_m")
    members = materialize(cells.join(shared, ["band", "key"]), "members")
    met = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    prints = materialize(rows.join(nodes.select("digest", "node"), "digest").select("node", "fp").distinct(), "prints")
    pairs = materialize(fingerprint_pairs(prints).unionByName(met).distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    wanted = nodes.join(asked, "node").select("doc_id", "mark", "node")
    sets = shingle_sets(docs, materialize(wanted, "wanted"), id_col, text, words)
    links = materialize(confirmed(pairs, sets, similarity), "near-links")
    named = members.join(components(links), "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("group"))
    named = named.join(nodes.select("node", "bands"), "node")
    more = unlinked_members(materialize(named, "named"), sets, similarity)
    labels = components(materialize(links.unionByName(more), "near-links"))
    placed = nodes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("group"))
    return materialize(rows.join(placed, "digest").select("doc_id", "mark", "n", "group"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    words: int = WORDS) -> DataFrame:
    """``doc_id, component_id``, a row per document: the smallest id reachable over pairs of the wanted similarity.

    Ids must not be null; rows that share an id but not a text are documents of their own; wordless texts are equal.
    """
    found = groups(docs, id_col, text, similarity, words)
    least = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return found.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).join(least, "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One document of each group, with all columns: the one with the smallest id; rows without an id stay.

    Only ids and text hashes of the rows that go are joined to the documents. Rows that repeat both the id and the text of
    one that stays are put together afterwards, and only those shuffle.
    """
    found = groups(docs.filter(F.col(id_col).isNotNull()), id_col, text, similarity, words)
    best = found.groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("_best"))
    judged = found.join(best, "group").withColumn("_stays", F.struct("doc_id", "mark") == F.col("_best"))
    judged = materialize(judged.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "n", "_stays"), "judged")
    same = (F.col(id_col).cast("bigint") == F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__mark"))
    out = judged.filter(~F.col("_stays") | (F.col("n") > 1)).select("__id", "__mark")
    rest = docs.join(broadcast_if_small(out, WANTED_ROWS), same, "left_anti")
    again = judged.filter(F.col("_stays") & (F.col("n") > 1)).select("__id", "__mark")
    if again.isEmpty():
        return rest
    repeated = docs.join(broadcast_if_small(again, WANTED_ROWS), same).dropDuplicates(["__id", "__mark"]).select(*docs.columns)
    return rest.unionByName(repeated)
