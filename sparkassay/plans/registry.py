"""Named queries and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkassay.sources.tables import TABLES, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(text: str) -> str:
    """Turn ``{table}`` placeholders into plain table names for the oracle side."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def query(name: str, oracle: str | None = None):
    """Register ``fn(warehouse) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Warehouse], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Warehouse(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = plain(oracle).strip()
        return fn

    return wrap
