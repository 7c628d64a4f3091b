"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may receive before the key is split further.
ROWS_PER_SALT = 200_000
# A key is hot only above total / MAX_HOT_KEYS rows, so there are never more hot keys than this.
MAX_HOT_KEYS = 1_000


def salted_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, count: str,
                rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Join rows to a side that is unique per ``key`` and carries the key's row count in ``count``.

    ``counts`` is the cheap ``(key, count)`` table behind that side. A key with n rows is spread over
    ``1 + n // threshold`` salts and its single right row is repeated once per salt, so a key with a third of all
    rows becomes many ordinary ones. A left row's salt is a hash of the row, stable under task retries. The
    broadcast lookup holds at most MAX_HOT_KEYS keys by construction.
    """
    total = counts.agg(F.sum(count)).scalar()
    threshold = F.greatest(F.lit(rows_per_salt).cast("double"), total / MAX_HOT_KEYS)
    extra = F.floor(F.col(count) / threshold).cast("int")
    hot = counts.filter(F.col(count) > threshold).select(F.col(key).alias("_hot"), extra.alias("_extra"))
    salted_left = (left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
                   .withColumn("_salt", F.when(F.col("_extra").isNull(), F.lit(0)).otherwise(
                       F.pmod(F.xxhash64(*left.columns), F.col("_extra") + 1).cast("int")))
                   .drop("_hot", "_extra"))
    salted_right = (right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), extra)))
                    .withColumnRenamed(key, "_key"))
    cond = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt_r"))
    return salted_left.join(salted_right, cond).drop("_key", "_salt", "_salt_r")
