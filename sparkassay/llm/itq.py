"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables, reranked with the vectors themselves.

A rotation learned on a bounded sample turns unit vectors into balanced binary codes. The code is cut into tables.
For a pair with cosine >= c the rotated vectors differ by at most 2 - 2c in squared length, so in at least one table
by at most (2 - 2c) / tables. A bit that differs there has coordinates of opposite signs, so it costs at least the
sum of both squared coordinates; over all differing bits one of the two sides pays no more than half. Every vector
therefore looks up, in each table, the codes it reaches by flips that cost no more than that half, and every such pair
is found from one side at least: the index loses nothing, and a false candidate is removed by the exact cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.components import components
from sparkassay.session import materialize

#: Vectors the rotation is learned on, at most; all vectors are indexed.
FIT_ROWS = 10_000
#: Rounds of alternating codes and rotation.
FIT_ROUNDS = 30
MAX_BITS = 64
#: Slack on the squared distance for rounding in double precision.
SLACK = 1e-9


def fit_rotation(sample: np.ndarray, rounds: int = FIT_ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)``: principal axes of unit vectors, then the rotation that brings codes and values closest."""
    dim = sample.shape[1]
    bits = min(dim, MAX_BITS)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    if len(sample) < 2:
        return mean, np.eye(dim, bits) @ rotation
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    projected = centred @ axes
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(projected.T @ codes)
        rotation = u @ vt
    return mean, axes @ rotation


def flips(values: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, code)``: every code of each row reachable by flipping bits whose squared values sum to the budget or less."""
    weights = np.left_shift(np.int64(1), np.arange(values.shape[1], dtype=np.int64))
    code = ((values >= 0) * weights).sum(axis=1)
    row, left = np.arange(len(values)), np.full(len(values), budget)
    for bit, cost in enumerate((values ** 2).T):
        can = np.flatnonzero(cost[row] <= left)
        row = np.concatenate([row, row[can]])
        code = np.concatenate([code, code[can] ^ weights[bit]])
        left = np.concatenate([left, left[can] - cost[row[len(left):]]])
    return row, code


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def stored_vectors(embeddings: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``id, label, dim, v`` (doubles), ``k`` (digest of label and vector); ``k`` is null for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims, keys, data = batch.column(1).to_pylist(), [], [], []
            for cell, tag in zip(batch.column(2), labels):
                v = None
                if cell.is_valid and tag is not None and len(cell.values) and not cell.values.null_count:
                    v = cell.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    # A finite, non-zero vector may be too long or short to square; a power of two changes no direction.
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                    else:
                        v = np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))
                b = None if v is None else v.tobytes()
                data.append(b)
                dims.append(None if v is None else len(v))
                name = b"" if b is None else str(tag).encode("utf-8", "surrogatepass")
                keys.append(None if b is None else hashlib.blake2b(len(name).to_bytes(8, "little") + name + b, digest_size=16).digest())
            yield pa.record_batch([batch.column(0), pa.array(labels, pa.string()), pa.array(dims, pa.int32()),
                                   pa.array(data, pa.binary()), pa.array(keys, pa.binary())], names=["id", "label", "dim", "v", "k"])

    rows = embeddings.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                             F.col(vector).alias("vector"))
    return rows.mapInArrow(run, "id bigint, label string, dim int, v binary, k binary")


def sample_models(reps: DataFrame, fit_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A rotation per vector length, each learned on ``fit_rows`` vectors at most, chosen by hash of the id."""
    models = {}
    for dim in [r["dim"] for r in reps.select("dim").distinct().collect()]:
        rows = reps.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").select("v").limit(fit_rows).toPandas()
        models[dim] = fit_rotation(unit_rows([bytes(b) for b in rows["v"]]))
    return models


def code_rows(models, tables: int, budget: float | None):
    """Arrow task giving ``id, label, dim, t, code``; with a budget all reachable codes, else the vector's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims = batch.column("id"), batch.column("label"), batch.column("dim").to_numpy()
            vectors = batch.column("v").to_pylist()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                mean, projection = models[int(dim)]
                y = (unit_rows([vectors[k] for k in mine]) - mean) @ projection
                cuts = [y.shape[1] * t // tables for t in range(tables + 1)]
                for t, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    for k in range(0, len(mine), 2048):
                        row, code = flips(y[k:k + 2048, lo:hi], -1.0 if budget is None else budget)
                        at = pa.array(mine[k + row])
                        yield pa.record_batch([ids.take(at), labels.take(at), pa.array(np.full(len(row), dim, np.int32)),
                                               pa.array(np.full(len(row), t, np.int32)), pa.array(code)],
                                              names=["id", "label", "dim", "t", "code"])

    return run


def linked_pairs(reps: DataFrame, threshold: float, tables: int, fit_rows: int) -> DataFrame:
    """``a < b``: all pairs of distinct vectors (``id, label, dim, v``) with equal labels and cosine >= threshold."""
    models = sample_models(reps, fit_rows)
    budget = (1 - threshold) / tables + SLACK
    schema = "id bigint, label string, dim int, t int, code bigint"
    source = reps.select("id", "label", "dim", "v")
    items = source.mapInArrow(code_rows(models, tables, None), schema).withColumnRenamed("id", "b")
    probes = source.mapInArrow(code_rows(models, tables, budget), schema).withColumnRenamed("id", "a")
    candidates = items.join(probes, ["label", "dim", "t", "code"]).filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # One pair's vectors have one length, but a batch may hold pairs of several.
            va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            size = np.array([len(x) for x in va])
            keep = np.zeros(len(va), dtype=bool)
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                keep[mine] = (unit_rows([va[k] for k in mine]) * unit_rows([vb[k] for k in mine])).sum(axis=1) >= threshold
            at = pa.array(np.flatnonzero(keep))
            yield pa.record_batch([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    vectors = reps.select("id", "v")
    with_a = candidates.join(vectors.toDF("a", "va"), "a")
    return with_a.join(vectors.toDF("b", "vb"), "b").select("a", "b", "va", "vb").mapInArrow(exact, "a bigint, b bigint")


def near_vectors(embeddings: DataFrame, threshold: float = 0.98, tables: int = 4, fit_rows: int = FIT_ROWS,
                 id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row: the vectors linked directly and the smallest id reachable.

    Only vectors with equal, non-null labels and equal lengths are compared. Null, empty and zero vectors, and those
    with null or non-finite components, link with nothing. Equal vectors of a label are one node and count as links
    of each other without meeting as pairs; rows that repeat an id count as further vectors. A row without an id has
    no links and is not kept. An empty table gives no rows; extra columns are ignored.
    """
    rows = materialize(stored_vectors(embeddings, id_col, vector, label), "vectors")
    valid = rows.filter("k is not null and id is not null")
    groups = materialize(valid.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-groups")
    owners = valid.join(groups.select("k", "rep"), "k").filter("id = rep").dropDuplicates(["k"])
    # Two labels may share an id; nodes are numbered by a hash of the digest so that they never mix.
    node = F.xxhash64("k")
    reps = materialize(owners.select(node.alias("id"), "label", "dim", "v"), "distinct-vectors")
    links = materialize(linked_pairs(reps, threshold, tables, fit_rows), "vector-links")
    sizes = groups.select(node.alias("id"), "n")
    both = links.select("a", "b").union(links.select("b", "a"))
    degree = both.join(sizes, both.b == sizes.id).groupBy("a").agg(F.sum("n").alias("more"))
    labels = components(links)
    named = (groups.select("k", "rep", "n", node.alias("id"))
             .join(labels, F.col("id") == F.col("node"), "left").join(degree, F.col("id") == F.col("a"), "left")
             .select("k", "rep", F.coalesce("component", "id").alias("c"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    named = materialize(named, "vector-nodes")
    lowest = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    final = materialize(named.join(lowest, "c").select("k", "n_links", "component_id"), "vector-components")
    key = F.when(F.col("id").isNotNull(), F.col("k"))
    out = rows.select("id", key.alias("k")).join(final, "k", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
