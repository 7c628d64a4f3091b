"""Session set-up and the one shared scratch folder the library writes to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "sparkassay", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here was planned for.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions`` generously:
    adaptive execution coalesces small partitions and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only where none is set and all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        configured = _LOCAL_DIRS.setdefault(app, "") or tempfile.mkdtemp(prefix="sparkassay-")
        _LOCAL_DIRS[app] = configured
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name for one materialised table or one stream."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Rows of about a megabyte each: a writer looks at what it holds after every few rows, and a reader decodes few at a time.
BLOCK_FILES = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def materialize(df, label: str, options: dict[str, str] | None = None):
    """Write once, read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").options(**options or {}).parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Hand freed memory back to the system; the worker lives on and serves later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Only the C library of Linux has it.
        pass
