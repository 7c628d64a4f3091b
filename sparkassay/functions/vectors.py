"""Vector columns: cosine, rescaled cosine, and a model-free hashed text vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkassay.functions.text import tokens


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product over norms in double precision; 0.0 when either norm is 0."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def rescaled(score: Column) -> Column:
    """Cosine mapped to [0, 1], as a store reporting ``1 - distance / 2`` does."""
    return 1 - (1 - score) / 2


def token_buckets(text: Column | str, dim: int) -> Column:
    return F.transform(tokens(text), lambda t: (
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))


def hash_vector(text: Column | str, dim: int = 64) -> Column:
    """Unit-length token-count vector over ``md5(token) % dim``; all zeros for a text without tokens.

    Tokens and buckets are JVM expressions; the Arrow step only counts integers, one row at a time, so the vector
    needs no explode and no shuffle.
    """

    @F.pandas_udf("array<double>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for buckets in batches:
            sizes = buckets.map(len).to_numpy()
            flat = np.concatenate(buckets.to_list()) if len(buckets) and sizes.sum() else np.zeros(0, dtype=np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            m = np.bincount(row * dim + flat.astype(np.int64), minlength=len(sizes) * dim)
            m = m.reshape(len(sizes), dim).astype(float)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            yield pd.Series(list(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))

    none = F.array().cast("array<bigint>")
    return count(F.coalesce(token_buckets(text, dim).cast("array<bigint>"), none))
