"""Packing of documents into fixed-length sequences by a configuration linear program over the length histogram.

The number of sequences depends on the lengths alone, so it is planned on the histogram, which has at most
``capacity`` rows whatever the corpus holds. The covering program (choose configurations, i.e. multisets of length
classes that fit a sequence, so that every piece is covered) is solved by multiplicative weights: the oracle of each
round is a knapsack over the present class weights, solved by dynamic programming, and a class that has been covered
more than others loses weight. The fractional counts are rounded down, filled with exact lengths, and what remains is
placed best-fit into the gaps and new sequences. The pieces themselves are numbered per length in Spark and meet the
plan in a lookup, so no document passes through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.wordids import word_encoder
from sparkassay.llm.worker import give_back, spread
from sparkassay.session import materialize

#: Bytes of ids after which a task hands its pieces on.
OUT_BYTES = 1 << 20
#: Lengths are planned in classes this wide; the program has capacity / GRAIN classes.
GRAIN = 8
#: Rounds of multiplicative weights.
ROUNDS = 1500
#: Shares of every configuration's count that are left to the best-fit step, which closes the gaps with them; the
#: solution is rounded with each in turn until one reaches the bound of total length over capacity, and the best counts.
RESERVES = (0.1, 0.2, 0.3, 0.4, 0.5)
#: Rows numbered by one window group, on average.
RANK_ROWS = 20_000


def best_configuration(weights: np.ndarray, bound: np.ndarray, room: int) -> np.ndarray:
    """Counts per class (class c takes c + 1 units) of the heaviest configuration in ``room`` units.

    Unbounded knapsack by dynamic programming; a class is offered only while ``bound`` is positive, and counts above
    the bound are cut, which keeps a configuration from covering more than is there.
    """
    offered = np.flatnonzero(bound > 0)
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = offered[:np.searchsorted(offered, c)]
        if len(fit):
            total = value[c - 1 - fit] + weights[fit]
            k = int(total.argmax())
            value[c], choice[c] = total[k], fit[k]
        if value[c - 1] >= value[c]:
            value[c], choice[c] = value[c - 1], -1
    counts, c = np.zeros(len(weights), dtype=np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= choice[c] + 1
    return np.minimum(counts, bound)


def solve_configurations(demand: np.ndarray, room: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fractional configurations covering ``demand`` (pieces per class), by multiplicative weights.

    Each round prices classes by how far they are behind, takes the best configuration, and gives it an equal share
    of the sequences; the shares are then scaled so that every class is covered.
    """
    live = demand > 0
    if not live.any():
        return []
    units = np.arange(1, len(demand) + 1)
    target = max(1.0, (demand * units).sum() / room)
    share = target / rounds
    covered = np.zeros(len(demand))
    eta = np.log(live.sum() + 1) * 2
    found: dict[bytes, list] = {}
    for t in range(1, rounds + 1):
        lag = np.where(live, t / rounds - covered / np.maximum(demand, 1), 0)
        price = np.where(live, units * np.exp(np.clip(eta * rounds ** 0.5 * lag, -40, 40)), 0)
        counts = best_configuration(price / price.max(), demand, room)
        found.setdefault(counts.tobytes(), [counts, 0.0])[1] += share
        covered += counts * share
    return [(c, x) for c, x in found.values()]


def plan_sequences(histogram: dict[int, int], capacity: int, grain: int = GRAIN, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as ``(lengths, how many alike)``, holding every piece of the histogram exactly once."""
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("piece lengths must be between 1 and the capacity")
    pieces = {n: c for n, c in histogram.items() if c > 0}
    full = [((capacity,), pieces.pop(capacity))] if capacity in pieces else []
    room = capacity // grain
    # A length too long for its class to fit beside anything still has the largest class.
    of_class: dict[int, list[int]] = defaultdict(list)
    for n in sorted(pieces, reverse=True):
        of_class[min(room, -(-n // grain)) - 1].append(n)
    demand = np.array([sum(pieces[n] for n in of_class[c]) for c in range(room)], dtype=np.int64)
    solution = sorted(solve_configurations(demand, room, rounds), key=lambda p: -p[1])
    bound = -(-sum(n * c for n, c in pieces.items()) // capacity)
    best: list[tuple[tuple[int, ...], int]] = []
    fewest = None
    for reserve in RESERVES:
        plan = round_solution(solution, pieces, of_class, capacity, reserve)
        size = sum(many for _, many in plan)
        if fewest is None or size < fewest:
            best, fewest = plan, size
        if fewest <= bound:
            break
    return full + best


def round_solution(solution: list[tuple[np.ndarray, float]], pieces: dict[int, int], of_class: dict[int, list[int]], capacity: int,
                   reserve: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole counts of the configurations less ``reserve``, filled with exact lengths; what remains is placed best-fit."""
    left = Counter(pieces)
    open_: list[tuple[tuple[int, ...], int]] = []
    for counts, x in solution:
        copies = int(x * (1 - reserve))
        slots = [c for c in np.flatnonzero(counts)[::-1] for _ in range(counts[c])]
        while copies and slots:
            # The longest lengths still there, one per slot, the last slot as tight as any length allows; as many
            # copies at once as those lengths last.
            pick: list[int] = []
            used: Counter = Counter()
            for k, c in enumerate(slots):
                if k + 1 < len(slots):
                    n = next((n for n in of_class[c] if left[n] > used[n]), None)
                else:
                    n = next((n for n in range(capacity - sum(pick), 0, -1) if left[n] > used[n]), None)
                if n is not None:
                    pick.append(n)
                    used[n] += 1
            if not pick:
                break
            many = min([copies] + [left[n] // k for n, k in used.items()])
            for n, k in used.items():
                left[n] -= many * k
            open_.append((tuple(pick), many))
            copies -= many
    return best_fit([(n, c) for n, c in left.items() if c], open_, capacity)


def best_fit(pieces: list[tuple[int, int]], open_: list[tuple[tuple[int, ...], int]], capacity: int):
    """Place ``(length, count)`` pieces, longest first, into the tightest gap; equal sequences move together."""
    gaps: dict[int, list[list]] = defaultdict(list)
    for lengths, many in open_:
        gaps[capacity - sum(lengths)].append([lengths, many])
    for n, count in sorted(pieces, reverse=True):
        while count:
            gap = min((g for g, rows in gaps.items() if g >= n and rows), default=None)
            if gap is None:
                per = capacity // n
                for fit, many in ((per, count // per), (count % per, 1)):
                    if fit and many:
                        gaps[capacity - fit * n].append([(n,) * fit, many])
                break
            row = gaps[gap][-1]
            fit = min(gap // n, count)
            many = min(row[1], count // fit)
            row[1] -= many
            if not row[1]:
                gaps[gap].pop()
            gaps[gap - fit * n].append([row[0] + (n,) * fit, many])
            count -= many * fit
    return [(tuple(lengths), many) for rows in gaps.values() for lengths, many in rows]


def assign(pieces: DataFrame, capacity: int = 2048, grain: int = GRAIN, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``doc_id``, ``piece`` and ``length`` (1 to capacity).

    Pieces of one length are interchangeable: they are numbered in groups of (length, hash bucket), so a length that
    a third of all pieces share is still spread, and the groups' starts come from their counts.
    """
    total = pieces.count()
    buckets = max(64, -(-total // RANK_ROWS))
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    groups = materialize(keyed.groupBy("length", "_b").agg(F.count("*").alias("_n")), "pack-groups")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    # At most `capacity` rows: one per length.
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece"))
    numbered = keyed.withColumn("_r", rank).join(starts, ["length", "_b"]).withColumn("_r", F.col("_s") + F.col("_r") - 1)
    place = _lookup(plan_sequences(histogram, capacity, grain, rounds))
    return numbered.withColumn("_p", place("length", "_r")).select(*pieces.columns, "_p.sequence_id", "_p.offset")


def _lookup(plan: list[tuple[tuple[int, ...], int]]):
    """Function of (length, number among its length) that gives a sequence and a place in it; other columns stay out of Python.

    The plan's size follows from the capacity and the rounds, not from the corpus: each length's numbers are cut into
    runs, and the numbers of a run go to consecutive sequences at one offset.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    first = 0
    for lengths, many in plan:
        at = 0
        for n in lengths:
            runs[n].append((used[n], first, at))
            used[n] += many
            at += n
        first += many
    table = {n: np.array(rows, dtype=np.int64) for n, rows in runs.items()}

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        for n in np.unique(length):
            rows, mine = table[int(n)], np.flatnonzero(length == n)
            k = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
            sequence[mine] = rows[k, 1] + rank[mine] - rows[k, 0]
            offset[mine] = rows[k, 2]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def cut_pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
               id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole texts: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its ids and then ``end_id`` (a null or empty text: ``end_id`` alone). Only a document longer than
    the capacity is cut, into pieces of the capacity and a rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = word_encoder(vocab), end_id.to_bytes(4, "little"), 4 * capacity
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        n = 6 if with_ids else 5

        def rows_of(out: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, k) for v, k in zip(out[:n], kinds)], names=names[:n])

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            held = 0
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(t.as_py()) + end
                for p, at in enumerate(range(0, len(data), step)):
                    ids = data[at:at + step]
                    for column, v in zip(out, (key, p, p * capacity, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None)):
                        column.append(v)
                held += len(data)
                if held >= OUT_BYTES:
                    yield rows_of(out)
                    out, held = [[], [], [], [], [], []], 0
            if out[0]:
                yield rows_of(out)
        give_back()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return spread(rows).mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and offset they are packed at; every text is tokenised once.

    Null ids and repeated rows are packed like any other; an empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(cut_pieces(docs, vocab, capacity, end_id, with_ids, id_col, text), "pieces")
    return assign(pieces, capacity)
