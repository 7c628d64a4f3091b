"""Cells of vectors for approximate top-k joins.

Every item belongs to the cell of its nearest centre and every query visits its nearest few cells, so a pair is scored
once and only where it can matter. Centres, and how many cells a query visits, are fitted on a bounded sample of the
items; every item is indexed. Queries meet the items of their cells as in the exact join (``pivots.PivotSearch``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkassay.operators import topk
from sparkassay.operators.topk import Side

# Items the centres are fitted on at most, and those of them that ask for their neighbours to set the probes.
FIT_ROWS = 20_000
FIT_QUERIES = 400
FIT_ROUNDS = 8
MAX_CELLS = 1_024
# Rows of one cell that are packed in one task, on average, and of one block.
CELL_ROWS = 8_192
BLOCK_ROWS = topk.BLOCK_ROWS
# Scores of rows and centres held at a time.
FIT_SCORES = 4_000_000


@dataclass(frozen=True)
class Cells:
    centres: np.ndarray
    probes: int


def unit_rows(vectors: pd.Series, width: int) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=float) for v in vectors]).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, width))
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def centres_of(m: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by k-means on unit vectors; a centre without rows stays where it was."""
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(FIT_ROUNDS):
        step = max(1, FIT_SCORES // len(centres))
        mine = np.concatenate([(m[at:at + step] @ centres.T).argmax(axis=1) for at in range(0, len(m), step)])
        order = np.argsort(mine, kind="stable")
        used, first = np.unique(mine[order], return_index=True)
        centres = centres.copy()
        centres[used] = np.add.reduceat(m[order], first, axis=0)
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.divide(centres, norm, out=np.zeros_like(centres), where=norm > 0)
    return centres


def fit_cells(m: np.ndarray, cells: int, k: int, target: float, seed: int) -> Cells:
    """Centres, and the fewest probes with which sampled rows find ``target`` of their neighbours."""
    rng = np.random.default_rng(seed)
    centres = centres_of(m, cells, rng)
    mine = (m @ centres.T).argmax(axis=1)
    asked = rng.choice(len(m), min(FIT_QUERIES, len(m)), replace=False)
    scores = m[asked] @ m.T
    # A row finds itself anyway.
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(m) - 1)]
    place = np.argsort(np.argsort(-(m[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, mine[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1 if len(needed) else 1
    return Cells(centres, min(probes, len(centres)))


def sampled(items: Side) -> tuple[np.ndarray, int]:
    """Unit vectors of at most ``FIT_ROWS`` finite, non-zero items spread over the table, and the number of items with a vector."""
    rows = items.narrow("i").filter(F.col("i_0").isNotNull())
    n = rows.count()
    share = int(min(1.0, FIT_ROWS / max(1, n)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64("i_id", "i_0"), F.lit(1 << 30)) <= share).limit(FIT_ROWS).toPandas()
    if sample.empty:
        sample = rows.limit(FIT_ROWS).toPandas()
    units = unit_rows(sample["i_0"], 1)
    good = units[np.isfinite(units).all(axis=1) & units.any(axis=1)]
    return (good if len(good) else units[:1] if np.isfinite(units).all() else units[:0]), n


def fit(items: Side, k: int, target: float, seed: int) -> Cells | None:
    """None without vectors."""
    sample, n = sampled(items)
    if not len(sample):
        return None
    return fit_cells(sample, min(MAX_CELLS, max(1, int(n ** 0.5))), k, target, seed)
