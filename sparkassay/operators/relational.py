"""Relational helpers that keep SQL semantics and still plan well on large inputs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.session import materialize

# Broadcast bound: rows, and bytes, that may be copied into every task.
MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Approximate size of a row from its own strings and arrays."""
    total = F.lit(16).cast("bigint")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            part = F.octet_length(c) + 16
        elif isinstance(f.dataType, T.ArrayType):
            part = F.size(c) * (24 if isinstance(f.dataType.elementType, T.StringType) else 8) + 16
        else:
            part = F.lit(8)
        total = total + F.coalesce(part, F.lit(8)).cast("bigint")
    return total


def rows_within(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> int | None:
    """Row count when the table stays inside both broadcast bounds, else None.

    A limited collect reads only as many partitions as it needs, so probing a huge table costs one small task.
    """
    probe = df.select(row_bytes(df).alias("b")).limit(max_rows + 1).toPandas()
    return len(probe) if len(probe) <= max_rows and probe["b"].sum() <= MAX_BROADCAST_BYTES else None


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where the measured size allows it; otherwise the join is left to shuffle."""
    return df if rows_within(df, max_rows) is None else F.broadcast(df)


def attach(hits: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Add item columns to a ranked list.

    The list (k rows per query) is written once so that ranking is not repeated; while it is small it is broadcast
    and the item texts are filtered where they are scanned instead of being shuffled.
    """
    return items.join(broadcast_if_small(materialize(hits, "hits"), 200_000), key)


def years(column: str, first: int, last: int | None = None) -> Column:
    """``YEAR(column) BETWEEN first AND last`` as a range, so it is pushed to the scan."""
    low = F.lit(dt.datetime(first, 1, 1)).cast("timestamp_ntz")
    high = F.lit(dt.datetime((last or first) + 1, 1, 1)).cast("timestamp_ntz")
    return (F.col(column) >= low) & (F.col(column) < high)


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``left_key NOT IN (SELECT right_key FROM right)`` for a right side of any size.

    Spark plans the plain form as a broadcast null-aware join. Here a shuffled anti join does the work; a null
    on the right empties the result and a null on the left never qualifies (unless the right side is empty).
    """
    keys = right.select(F.col(right_key).alias("_k"))
    state = keys.agg(F.count("*").alias("n"), F.count_if(F.col("_k").isNull()).alias("nulls"))
    has_null = state.select(F.col("nulls") > 0).scalar()
    is_empty = state.select(F.col("n") == 0).scalar()
    kept = left.join(keys.filter(F.col("_k").isNotNull()), F.col(left_key) == F.col("_k"), "left_anti")
    return kept.filter(~has_null & (F.col(left_key).isNotNull() | is_empty))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    The ``rank <= k`` filter is pushed below the shuffle as a per-partition group limit, so a hot group sends at
    most ``k`` rows per input partition to its final task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
