"""A vector index as a versioned table on shared storage: add, query, count, reset.

``add`` writes one version: the given rows, then its line in the manifest. Readers see the versions of the manifest only,
so a write that failed half-way is never read and may be repeated. Cells around pivots are made when a query first needs
them: pivots are fitted once, on the first version with vectors, and kept; every version is placed once and its blocks are
stored beside it, so adding rows never touches older ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.operators.pivots import PivotSearch, fitted_pivots, item_blocks, place_items
from sparkassay.operators.relational import MAX_BROADCAST_ROWS
from sparkassay.operators.retrieval import cosine_kernel
from sparkassay.operators.topk import Side, topk_join
from sparkassay.session import BLOCK_FILES

_MANIFEST = "version long, n_rows long"
_PIVOTS = "cell int, pivot array<double>"
_BLOCKS = "cell int, lo double, hi double, n int, i_block binary"


class VectorIndex:
    """Rows with a unique ``key`` and a ``vector`` column, and any others, which ``rows`` gives back."""

    def __init__(self, spark: SparkSession, path: str, key: str, vector: str = "embedding"):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A stored table, or None where there is none; asked of the file system that Spark itself writes to."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Committed versions, a number each, since the last reset."""
        manifest = self._read("manifest", _MANIFEST)
        if manifest is None:
            return []
        numbers = [(r["version"], r["n_rows"]) for r in manifest.orderBy("version").collect()]
        last_reset = max((v for v, n in numbers if n < 0), default=0)
        return [v for v, _ in numbers if v > last_reset]

    def _commit(self, version: int, n: int) -> None:
        self.spark.createDataFrame([(version, n)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _next(self) -> int:
        manifest = self._read("manifest", _MANIFEST)
        return 1 if manifest is None else (manifest.agg(F.max("version")).first()[0] or 0) + 1

    def add(self, rows: DataFrame) -> int:
        """Store ``rows`` as a new version and return its number."""
        version = self._next()
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        self._commit(version, self.spark.read.parquet(f"{self.path}/rows/version={version}").count())
        return version

    def reset(self) -> None:
        """Forget all versions; their files stay until the folder is cleaned up."""
        self._commit(self._next(), -1)

    def rows(self) -> DataFrame | None:
        """All rows of all versions, or None for an empty index."""
        found = [f"{self.path}/rows/version={v}" for v in self.versions()]
        return self.spark.read.parquet(*found) if found else None

    def count(self) -> int:
        """From the manifest alone."""
        live = set(self.versions())
        manifest = self._read("manifest", _MANIFEST)
        return sum(r["n_rows"] for r in manifest.collect() if r["version"] in live) if live else 0

    def _pivots(self) -> np.ndarray | None:
        stored = self._read("pivots", _PIVOTS)
        if stored is None:
            pivots = fitted_pivots(Side(self.rows(), self.key, (self.vector,)))
            if pivots is None:
                return None
            cells = [(i, [float(x) for x in p]) for i, p in enumerate(pivots)]
            self.spark.createDataFrame(cells, _PIVOTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots")
            return pivots
        return np.array([r["pivot"] for r in stored.orderBy("cell").collect()])

    def _blocks(self, pivots: np.ndarray) -> DataFrame:
        """Blocks of all versions; those that have none yet are placed now."""
        placed = self._read("placed", "version long")
        done = set() if placed is None else {r["version"] for r in placed.collect()}
        for version in self.versions():
            if version not in done:
                mine = self.spark.read.parquet(f"{self.path}/rows/version={version}")
                blocks = item_blocks(place_items(Side(mine, self.key, (self.vector,)), pivots))
                blocks.write.mode("overwrite").options(**BLOCK_FILES).parquet(f"{self.path}/blocks/version={version}")
                self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.path}/placed")
        return self.spark.read.schema(_BLOCKS).parquet(*[f"{self.path}/blocks/version={v}" for v in self.versions()])

    def query(self, queries: DataFrame, q_id: str, k: int, vector: str = "embedding", *, q_out: str = "query_id", i_out: str = "item_id",
              max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
        """The k nearest rows by cosine, exactly: ``q_out, rank, i_out, score``. A short list of queries reads the rows as they lie."""
        rows = self.rows()
        if rows is None:
            kinds = [T.StructField(q_out, queries.schema[q_id].dataType), T.StructField("rank", T.IntegerType()),
                     T.StructField(i_out, queries.schema[q_id].dataType), T.StructField("score", T.DoubleType())]
            return self.spark.createDataFrame([], T.StructType(kinds))

        def far(asked, items, kernel, k, lanes):
            pivots = self._pivots()
            placed = (pivots, self._blocks(pivots)) if pivots is not None else (None, None)
            return PivotSearch(asked, items, kernel, k, placed=placed).hits()

        return topk_join(Side(queries, q_id, (vector,)), Side(rows, self.key, (self.vector,)), cosine_kernel, k,
                         q_out=q_out, i_out=i_out, max_rows=max_rows, far=far)
