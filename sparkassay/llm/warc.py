"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join.

An archive folder has two tables. ``payloads``: ``digest`` (SHA-256 of the bytes) and ``payload``. ``headers``: the
exact header block of every record and the digest it refers to. Equal digests with different lengths stop the write,
and a read recomputes every digest. ``export_files`` writes the rebuilt records as ordinary WARC files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.session import materialize, scratch_path

#: Payloads shorter than this are always responses.
MIN_REVISIT = 100
#: The tables hold no fetch time, so records carry this one unless another is given.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: Column) -> Column:
    """A name-based identifier of a page's record."""
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"), 256)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_block(date: str) -> Column:
    """The header lines of a record, closed by an empty line; line breaks inside a URL are percent-encoded."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html",
                  min_revisit: int = MIN_REVISIT, date: str = DATE) -> str:
    """Write one record per row; returns the archive folder.

    Of equal payloads of at least ``min_revisit`` bytes the smallest id is the response and the others revisit it. A null
    text is an empty payload. A row without an id is a response of its own, and a row that repeats the response's id
    is a response again. Payloads are shuffled once, to their ids' owners.
    """
    path = path or scratch_path(pages.sparkSession, "archive")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    rows = materialize(rows, "records")
    owners = rows.groupBy("digest").agg(F.min("page_id").alias("owner"), F.min("payload_bytes").alias("_low"), F.max("payload_bytes").alias("_high"))
    same = F.assert_true(F.col("_low") == F.col("_high"), F.lit("payloads of different lengths share a digest"))
    owners = materialize(owners.withColumn("_ok", same).select("digest", "owner", F.col("_ok").cast("string").alias("_ok")), "owners").drop("_ok")
    again = (F.col("payload_bytes") >= min_revisit) & (F.col("page_id") != F.col("owner"))
    typed = rows.join(owners, "digest").withColumn("record_type", F.when(F.coalesce(again, F.lit(False)), "revisit").otherwise("response"))
    typed = typed.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("owner")))
    typed.select("page_id", "digest", header_block(date).cast("binary").alias("header"), "refers_to").write.parquet(f"{path}/headers")
    # The owner's row brings the bytes; digests owned by no id at all take them from any of their rows.
    bodies = pages.select(F.col(id_col).cast("bigint").alias("page_id"), payload.alias("payload"))
    owned = (owners.filter("owner is not null").join(bodies, F.col("owner") == F.col("page_id"))
             .filter(F.sha2("payload", 256) == F.col("digest")).select("digest", "payload"))
    # Only an owner that stands in several rows brings its bytes more than once.
    repeated = rows.join(owners, (rows.digest == owners.digest) & (rows.page_id == owners.owner), "left_semi")
    if not repeated.groupBy("page_id", "digest").count().filter("count > 1").isEmpty():
        owned = owned.dropDuplicates(["digest"])
    lone = bodies.filter("page_id is null").select(F.sha2("payload", 256).alias("digest"), "payload").join(
        owners.filter("owner is null"), "digest", "left_semi").dropDuplicates(["digest"])
    owned.unionByName(lone).write.parquet(f"{path}/payloads")
    return path


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, header, payload, digest, record_type, refers_to`` of every record, rebuilt from the two tables.

    ``payload`` is the full payload, a revisit's that of its response. A payload that does not give its digest stops
    the read. One digest may be that of very many records: both sides of the join are stored tables, so adaptive
    execution splits such a key.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest")).cast("binary"))
    headers = spark.read.parquet(f"{path}/headers")
    return headers.join(payloads.select("digest", sound.alias("payload")), "digest", "left").select(
        "page_id", "header", "payload", F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        _field("WARC-Type").alias("record_type"), "refers_to")


def rebuilt_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record``: the exact bytes of each record without the two line breaks that part records."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_archive(spark, path).select("page_id", F.concat("header", block).alias("record"))


def export_files(spark: SparkSession, path: str, target: str, records_per_file: int = 50_000) -> None:
    """Ordinary uncompressed WARC files, through Spark's text writer with the record separator as its line end."""
    records = rebuilt_records(spark, path).select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(target)


def stored_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the archive, read it back and describe every record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    records = read_archive(pages.sparkSession, write_archive(pages, **options))
    return records.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                          F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
