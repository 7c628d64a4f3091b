"""Readers for the columnar warehouse tables, question files and documents, and the chunk index table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions.text import strip

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("expected_rows", T.VariantType()),
    T.StructField("notes", T.StringType()),
])


class Warehouse:
    """Lazy attribute access to ``<root>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def spread(self, name: str, most: int | None = None) -> DataFrame:
        """The table with at least one partition per core, for CPU-heavy row work.

        A no-op on large tables, whose scan already has more splits than cores. With ``most`` the partitions also follow the
        rows, so many to a partition on average: where a row takes long, a split of many small rows would be one long task.
        """
        df = getattr(self, name)
        parts = self.spark.sparkContext.defaultParallelism
        if most is not None:
            parts = max(parts, -(-df.count() // most))
        return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)

    def sql(self, text: str, spread: bool = False, most: int | None = None) -> DataFrame:
        """Run SQL text in which ``{table}`` names a warehouse table; ``spread`` and ``most`` as in ``spread``."""
        used = {name: self.spread(name, most) if spread else getattr(self, name) for name in TABLES if "{" + name + "}" in text}
        text = text.replace("{", "{{").replace("}", "}}")
        for name in used:
            text = text.replace("{{" + name + "}}", "{" + name + "}")
        return self.spark.sql(text, **used)


def save_star(wh: Warehouse, target: str, names: tuple[str, ...], force: bool = False) -> None:
    """Copy tables to a managed location: create if missing, or rewrite when ``force``."""
    for name in names:
        getattr(wh, name).write.mode("overwrite" if force else "ignore").parquet(f"{target}/{name}.parquet")


def load_questions(spark: SparkSession, path: str, difficulty: str | None = None, multi_line: bool = True) -> DataFrame:
    """Question files: JSON arrays, or one object per line with ``multi_line=False`` (which splits large files)."""
    df = spark.read.schema(QUESTION_SCHEMA).option("multiLine", multi_line).json(path)
    if difficulty is not None:
        df = df.filter(F.col("difficulty") == difficulty)
    return df.withColumn("notes", F.coalesce("notes", F.lit("")))


def expected_cells(df: DataFrame, rows: str = "expected_rows") -> DataFrame:
    """Explode the heterogeneous golden rows into the long ``(id, row_no, cells)`` result form.

    Cells use the canonical text of executed results: numbers to two digits, strings stripped and tagged apart.
    """

    def cell(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.bround(F.try_variant_get(v, "$", "decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")
        return (F.when(kind == "VOID", F.lit(None).cast("string"))
                .when(kind == "STRING", F.concat(F.lit("s:"), strip(F.try_variant_get(v, "$", "string"))))
                .when(kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(v, "$", "string")))
                .otherwise(F.concat(F.lit("n:"), number)))

    as_rows = F.col(rows).cast("array<array<variant>>")
    return df.select("id", F.posexplode(as_rows).alias("row_no", "raw")).select(
        "id", "row_no", F.transform("raw", cell).alias("cells"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text or markdown files, one document each, with file name and path as metadata."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.select(
        F.col("value").alias("text"),
        F.create_map(
            F.lit("source"), F.col("_metadata.file_name"),
            F.lit("path"), F.col("_metadata.file_path"),
        ).alias("metadata"),
    )


def docs_from_texts(df: DataFrame, text: str = "text", source: str | Column = "unknown") -> DataFrame:
    """Attach a ``source`` metadata entry to raw texts."""
    value = F.lit(source) if isinstance(source, str) else source
    return df.withColumn("metadata", F.create_map(F.lit("source"), value)).withColumnRenamed(text, "text")


class ChunkIndex:
    """An append-only chunk table on shared storage: add, reset, count, read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def add(self, chunks: DataFrame) -> None:
        chunks.write.mode("append").parquet(self.path)

    def reset(self, chunks: DataFrame) -> None:
        """Empty the index, keeping the column layout of ``chunks``."""
        chunks.limit(0).write.mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("n_chunks"))
