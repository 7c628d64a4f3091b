"""Exact top-k by cosine for two large sides: items in cells around pivots, bounds from the triangle inequality on angles.

Angles between vectors are a metric, so a query at angle a from a pivot is at least a - hi, and at least lo - a, from every
item whose angle from that pivot lies in [lo, hi]. A query first meets its nearest cell, which gives k scores; their
smallest is an angle within which all better items lie. It then meets only cells, and inside a cell only blocks, that reach
into that angle. On clustered vectors most cells are never met. On vectors without any structure every query meets every
cell: all pairs are scored, block by block in bounded memory, as there is no bound to save one.

What moves does not grow with the number of cells: cells are put together in regions of a bounded number of items, and a
query is sent once to each region that holds a cell it meets. There the blocks it meets are found again from the pivots.
The blocks of a region are repeated only for as many tasks as the queries that came to it need.

Pivots are fitted on a bounded sample; every item belongs to exactly one cell. Vectors of length zero have cosine 0 with
everything and a cell of their own at a right angle. Null and non-finite vectors are in no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkassay.operators.cells import CELL_ROWS, centres_of, sampled, unit_rows
from sparkassay.operators.relational import top_per_group
from sparkassay.operators.topk import BLOCK_ROWS, SCORE_DIGITS, Kernel, Side, _frame, _ipc, best_rows
from sparkassay.session import BLOCK_FILES, give_back, materialize

# Bytes of pivots sent to every task.
PIVOT_BYTES = 16 << 20
ZERO_CELL = -1
RIGHT = np.pi / 2
# Scores are compared after rounding to six digits; angles carry the rounding of arccos near 0.
SCORE_SLACK, ANGLE_SLACK = 1e-6, 1e-7
# Angles, and scores of queries and items, that a task holds at a time.
ANGLES, SCORES = 1_000_000, 1_000_000
# Queries packed at a time, items of a region, and queries that meet a region in one task, on average.
QUERY_ROWS = 2_048
REGION_ROWS, SPLIT_QUERIES = 65_536, 32_768


def _finite(column: pd.Series) -> np.ndarray:
    return np.array([v is not None and bool(np.isfinite(np.asarray(v, dtype=float)).all()) for v in column], dtype=bool)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _nearest(units: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the angle from it, some rows at a time: their number falls as that of the pivots grows."""
    cell, near = np.empty(len(units), np.int64), np.empty(len(units))
    step = max(1, ANGLES // len(pivots))
    for at in range(0, len(units), step):
        cosine = units[at:at + step] @ pivots.T
        cell[at:at + step] = mine = cosine.argmax(axis=1)
        near[at:at + step] = np.arccos(np.clip(cosine[np.arange(len(mine)), mine], -1.0, 1.0))
    return cell, near


def place_items(items: Side, pivots: np.ndarray) -> DataFrame:
    """Items with their cell and angle from its pivot."""
    rows = items.narrow("i").filter(F.col("i_0").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[_finite(pdf["i_0"])]
            if not len(pdf):
                continue
            units = unit_rows(pdf["i_0"], pivots.shape[1])
            cell, near = _nearest(units, pivots)
            zero = ~units.any(axis=1)
            yield pdf.assign(cell=np.where(zero, ZERO_CELL, cell).astype(np.int32), angle=np.where(zero, RIGHT, near))

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return materialize(rows.mapInPandas(run, schema), "pivot-cells")


def item_blocks(placed: DataFrame, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``cell, lo, hi, n, i_block``: blocks of items of a cell, of neighbouring angles. A large cell is cut into many splits."""
    counts = placed.groupBy("cell").agg(F.count("*").alias("_n"))
    keyed = placed.join(F.broadcast(counts), "cell").withColumn(
        "_split", F.pmod(F.xxhash64("i_id"), (1 + F.floor(F.col("_n") / cell_rows)).cast("bigint"))).drop("_n")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (cell, _), part in pdf.groupby(["cell", "_split"], sort=False):
                angle, part = part["angle"].to_numpy(), part.drop(columns=["cell", "_split", "angle"])
                for at in range(0, len(part), block_rows):
                    held = angle[at:at + block_rows]
                    yield pd.DataFrame({"cell": np.int32(cell), "lo": [held.min()], "hi": held.max(), "n": np.int32(len(held)),
                                        "i_block": [_ipc(part.iloc[at:at + block_rows])]})

    ordered = keyed.repartition("cell", "_split").sortWithinPartitions("cell", "_split", "angle")
    return materialize(ordered.mapInPandas(pack, "cell int, lo double, hi double, n int, i_block binary"), "pivot-blocks", BLOCK_FILES)


def _cell_angles(units: np.ndarray, pivots: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A column per cell: the queries' angles from its pivot, a right angle for the cell of zero vectors."""
    real = cells != ZERO_CELL
    angle = np.full((len(units), len(cells)), RIGHT)
    angle[:, real] = _angles(units, pivots[cells[real]])
    return angle


def _regions(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Per cell its first region and its number of regions, and the number of all; a cell of too many items has several."""
    n = cells["n"].to_numpy()
    first, parts = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    region, held = 0, 0
    for at, size in enumerate(n):
        if held and held + size > REGION_ROWS:
            region, held = region + 1, 0
        first[at], parts[at] = region, max(1, -(-int(size) // REGION_ROWS))
        region, held = (region + parts[at], 0) if parts[at] > 1 else (region, held + size)
    return first, parts, int(region) + 1


def _best_above(kernel: Kernel, queries: pd.DataFrame, items: pd.DataFrame, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query row, item id, rounded score`` of at least the k best items whose score may reach the query's floor."""
    scores = kernel(queries, items)
    ids = items["i_id"].to_numpy()
    row, col = np.divmod(np.flatnonzero(scores >= floor[None, :] - SCORE_SLACK), max(1, len(queries)))
    if len(row) > 8 * k * len(queries):
        scores = np.round(scores, SCORE_DIGITS) + 0.0
        row, col = best_rows(scores, ids, k)
        return col, ids[row], scores[row, col]
    return col, ids[row], np.round(scores[row, col], SCORE_DIGITS) + 0.0


class _Held:
    """The k best items so far of each query of a block."""

    def __init__(self, queries: pd.DataFrame, floor: np.ndarray, k: int):
        self.queries, self.floor, self.k = queries, floor, k
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)

        self.units = unit_rows(queries["q_0"], 1).T.astype(np.float32)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_more = 0

    def likely(self, rows: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and ``rows`` with a pair whose cosine may reach the floor: single precision, less all that it may be wrong by."""
        wrong = (len(self.units) + 8) * 2.0 ** -24
        mine = self.units if len(rows) == self.units.shape[1] else self.units[:, rows]
        met = units @ mine >= (self.floor[rows] - SCORE_SLACK - wrong).astype(np.float32)
        return np.flatnonzero(met.any(axis=1)), rows[met.any(axis=0)]

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Put together at once while a query has no floor yet, else when there is a row for each query."""
        self.more.append((rows, ids, scores))
        self.n_more += len(rows)
        if self.n_more >= len(self.queries) or np.isneginf(self.floor).any():
            self.merge()

    def merge(self) -> None:
        if not self.more:
            return
        rows, ids, scores = (np.concatenate(parts) for parts in zip(*self.more))
        self.more, self.n_more = [], 0
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids.astype(str) if ids.dtype == object else ids, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        top = place < self.k
        self.rows, self.ids, self.scores = rows[top], ids[order][top], scores[order][top]
        last = place[top] == self.k - 1
        self.floor[self.rows[last]] = np.maximum(self.floor[self.rows[last]], self.scores[last])


def fitted_pivots(items: Side, cells: int | None = None, seed: int = 7) -> np.ndarray | None:
    """Pivots for the items: about the square root of their number, as far as ``PIVOT_BYTES`` allows. None without vectors."""
    sample, n = sampled(items)
    if not len(sample):
        return None
    most = max(1, PIVOT_BYTES // (8 * sample.shape[1]))
    return centres_of(sample, min(cells or max(1, min(int(n ** 0.5), n // 64)), most, len(sample)), np.random.default_rng(seed))


class PivotSearch:
    """The cells of the items, and what queries meet of them. ``placed`` gives pivots and stored blocks where they exist."""

    def __init__(self, queries: Side, items: Side, kernel: Kernel, k: int, cells: int | None = None,
                 placed: tuple[np.ndarray | None, DataFrame | None] | None = None):
        self.kernel, self.k = kernel, k
        self.asked = queries.narrow("q").filter(F.col("q_0").isNotNull())
        self.schema = T.StructType([T.StructField("q_id", queries.df.schema[queries.key].dataType),
                                    T.StructField("i_id", items.df.schema[items.key].dataType), T.StructField("score", T.DoubleType())])
        self.pivots, self.blocks = placed or (fitted_pivots(items, cells), None)
        if self.pivots is None:
            return
        if self.blocks is None:
            self.blocks = item_blocks(place_items(items, self.pivots))
        # One row per pivot.
        self.cells = self.blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas()

        self.first, self.parts, self.n_regions = _regions(self.cells)

    def _visits(self, queries: DataFrame, pick) -> DataFrame:
        """``region, turn, n, q_block``: queries packed for each region in which they meet a cell, stored; ``turn`` deals them out.

        ``pick(angles, reach)`` says which cells a query meets and what ``limit`` tells them apart in the region.
        """
        order, pivots, first, parts = self.cells["cell"].to_numpy(), self.pivots, self.first, self.parts
        # A row per cell and region of it.
        cell_of = np.repeat(np.arange(len(order)), parts)
        region_of = np.repeat(first, parts) + np.arange(len(cell_of)) - np.repeat(np.cumsum(parts) - parts, parts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            turn = TaskContext.get().partitionId()
            for whole in batches:
                for at in range(0, len(whole), QUERY_ROWS):
                    pdf = whole.iloc[at:at + QUERY_ROWS]
                    pdf = pdf[_finite(pdf["q_0"])]
                    if not len(pdf):
                        continue
                    turn += 1
                    units = unit_rows(pdf["q_0"], pivots.shape[1])
                    reach = np.where(units.any(axis=1), pdf["reach"].to_numpy(), np.pi)
                    step = max(1, ANGLES // len(order))
                    picked = [pick(_cell_angles(units[i:i + step], pivots, order), reach[i:i + step]) for i in range(0, len(units), step)]
                    met, limit = (np.concatenate(parts) for parts in zip(*picked))
                    held = pdf.assign(limit=limit)
                    for region in np.unique(region_of):
                        rows = met[:, cell_of[region_of == region]].any(axis=1)
                        if rows.any():
                            yield pd.DataFrame({"region": [int(region)], "turn": turn, "n": int(rows.sum()), "q_block": [_ipc(held[rows])]})

        return materialize(queries.mapInPandas(run, "region long, turn long, n long, q_block binary"), "visits", BLOCK_FILES)

    def _splits(self, visits: DataFrame, tasks: int) -> DataFrame:
        """``region, splits``: tasks of a region, by the queries that came to it, and about ``tasks`` in all where they suffice."""
        met = visits.groupBy("region").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).toPandas()
        least = np.minimum(-(-tasks // max(1, len(met))), met["blocks"])
        met["splits"] = np.maximum(-(-met["n"] // SPLIT_QUERIES), least)
        return F.broadcast(visits.sparkSession.createDataFrame(met[["region", "splits"]], "region long, splits long"))

    def _placed_blocks(self, splits: DataFrame) -> DataFrame:
        """The item blocks of the regions met, once for every split of their queries."""
        table = pd.DataFrame({"cell": self.cells["cell"].astype("int32"), "_first": self.first, "_parts": self.parts})
        places = F.broadcast(self.blocks.sparkSession.createDataFrame(table, "cell int, _first long, _parts long"))
        at = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("lo", "hi", "i_block"), F.col("_parts"))).otherwise(F.lit(0))
        placed = self.blocks.join(places, "cell").withColumn("region", F.col("_first") + at).join(splits, "region")
        return placed.select("cell", "lo", "hi", "n", "i_block", "region",
                             F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("splits") - 1)).alias("split"))

    def _meet(self, visits: DataFrame, schema, near: bool, work, tasks: int = 1) -> DataFrame:
        """``work(blocks, queries, meets)`` per region and split; ``meets(cell, lo, hi, queries)`` marks the queries that a block may serve.

        ``near``: a query's limit is the angle of the farthest cell it meets; else all within that angle of it are met.
        """
        pivots = self.pivots

        def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
            queries = [_frame(q.as_buffer()) for q in asked.column("q_block")]
            units = [unit_rows(q["q_0"], pivots.shape[1]) for q in queries]
            limits = [q["limit"].to_numpy() for q in queries]

            def meets(cell: int, lo: float, hi: float, at: int) -> np.ndarray:
                angle = _cell_angles(units[at], pivots, np.array([cell]))[:, 0]
                least = angle if near or cell == ZERO_CELL else np.maximum(np.maximum(angle - hi, lo - angle), 0.0)
                return least <= limits[at]

            found = work(blocks, queries, meets)
            give_back()
            return found

        keys = ["region", "split"]
        splits = self._splits(visits, tasks)
        dealt = visits.join(splits, "region").select("region", F.pmod("turn", "splits").alias("split"), "q_block")
        return self._placed_blocks(splits).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(run, schema)

    def _scores(self, visits: DataFrame, near: bool, tasks: int = 1) -> DataFrame:
        kernel, k = self.kernel, self.k
        kinds = to_arrow_schema(self.schema)

        def work(blocks: pa.Table, queries: list[pd.DataFrame], meets) -> pa.Table:
            held = [_Held(q, q["floor"].to_numpy().copy(), k) for q in queries]
            # The blocks of a cell lie together; what is found in one raises the floor for the next.
            for cell, lo, hi, data in zip(*[blocks.column(c).to_pylist() for c in ("cell", "lo", "hi")], blocks.column("i_block")):
                items = None
                for at, mine in enumerate(held):
                    rows = np.flatnonzero(meets(cell, lo, hi, at))
                    if not len(rows):
                        continue
                    if items is None:
                        items = _frame(data.as_buffer())
                        units = unit_rows(items["i_0"], 1).astype(np.float32)
                    step = max(1, SCORES // len(rows))
                    for i in range(0, len(items), step):
                        near, asking = mine.likely(rows, units[i:i + step])
                        if not len(near):
                            continue
                        found = _best_above(kernel, mine.queries.iloc[asking], items.iloc[i + near], k, mine.floor[asking])
                        if len(found[0]):
                            mine.add(asking[found[0]], *found[1:])
            for mine in held:
                mine.merge()
            full = [h for h in held if h.ids is not None]
            parts = [pa.table([pa.array(h.queries["q_id"].to_numpy()[h.rows], kinds.field(0).type, from_pandas=True),
                               pa.array(h.ids, kinds.field(1).type, from_pandas=True), pa.array(h.scores, pa.float64())], schema=kinds) for h in full]
            return pa.concat_tables(parts) if parts else kinds.empty_table()

        return self._meet(visits, self.schema, near, work, tasks)

    def _unbounded(self) -> DataFrame:
        """The queries before anything is known of their scores."""
        return self.asked.withColumn("reach", F.lit(float(np.pi))).withColumn("floor", F.lit(float("-inf")))

    def _tasks(self) -> int:
        return self.asked.sparkSession.sparkContext.defaultParallelism

    def visits(self) -> DataFrame:
        """Queries packed for every region with a cell within reach of their k-th score in the nearest cells that hold k items."""
        k = self.k
        size, lo, hi = (self.cells[c].to_numpy() for c in ("n", "lo", "hi"))
        zero = self.cells["cell"].to_numpy() == ZERO_CELL

        def nearest(angle: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            met = np.zeros(angle.shape, dtype=bool)
            np.put_along_axis(met, order, before < k, axis=1)
            return met, np.where(met, angle, 0.0).max(axis=1) + ANGLE_SLACK

        def within(angle: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            least = np.where(zero, RIGHT, np.maximum(np.maximum(angle - hi, lo - angle), 0.0))
            return least <= reach[:, None] + ANGLE_SLACK, reach

        # A query meets few items here, so these blocks are not repeated for the sake of more tasks.
        none = F.lit(float("-inf"))
        first = top_per_group(self._scores(self._visits(self._unbounded(), nearest), True), ["q_id"], [F.desc("score"), F.col("i_id")], k)
        bound = first.groupBy("q_id").agg(F.count("*").alias("_n"), F.min("score").alias("_s")).filter(F.col("_n") >= k)
        reach = F.acos(F.greatest(F.lit(-1.0), F.col("_s") - SCORE_SLACK)) + ANGLE_SLACK
        bound = bound.select(F.col("q_id").alias("_q"), reach.alias("_r"), "_s")
        asked = (self.asked.join(bound, F.col("q_id") == F.col("_q"), "left").withColumn("reach", F.coalesce("_r", F.lit(float(np.pi))))
                 .withColumn("floor", F.coalesce("_s", none)).drop("_q", "_r", "_s"))
        return self._visits(asked, within)

    def hits(self) -> DataFrame:
        """``q_id, i_id, score``: at least the k best items of every query."""
        if self.pivots is None:
            return self.asked.sparkSession.createDataFrame([], self.schema)
        return self._scores(self.visits(), False, self._tasks())

    def near_hits(self, probes: int) -> DataFrame:
        """``q_id, i_id, score``: at least the k best items of every query in the ``probes`` cells nearest to it."""
        if self.pivots is None:
            return self.asked.sparkSession.createDataFrame([], self.schema)
        real = np.flatnonzero(self.cells["cell"].to_numpy() != ZERO_CELL)

        def nearest(angle: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            limit = np.full(len(angle), np.pi)
            if probes < len(real):
                limit = np.partition(angle[:, real], probes - 1, axis=1)[:, probes - 1]
            return angle <= limit[:, None] + ANGLE_SLACK, limit + ANGLE_SLACK

        return self._scores(self._visits(self._unbounded(), nearest), True, self._tasks())

    def scored(self) -> int:
        """Pairs of a query and an item that are scored after the bound is known."""
        if self.pivots is None:
            return 0

        def count(blocks: pa.Table, queries: list[pd.DataFrame], meets) -> pa.Table:
            rows = zip(*[blocks.column(c).to_pylist() for c in ("cell", "lo", "hi", "n")])
            return pa.table({"n": [sum(int(meets(cell, lo, hi, at).sum()) * n for cell, lo, hi, n in rows for at in range(len(queries)))]})

        return int(self._meet(self.visits(), "n long", False, count).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
