"""A content-addressed WARC archive in two tables.

    payloads   digest, payload        every distinct payload once, under its SHA-256
    headers    page_id, digest, header   the exact header block of each record, in WARC/1.1

Of pages with equal payloads of at least `least_bytes` bytes, the one with the smallest page_id is a `response`; the others are `revisit`
records that name it and carry no body. Smaller payloads are always `response`, yet stored once as well. Reading joins headers with payloads,
checks each payload against its digest, and gives back the records byte for byte.

Rows: one record for each page row. A null html is an empty payload. Rows that repeat page_id and payload are the same record, so they
have the same type. A missing page_id is written as an empty record id; such a row revisits the smallest page_id of its payload, and is a
response if no row of it has one. A null url leaves the target out; line breaks in a url are percent-encoded. Payloads may be of any length;
other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 100
NO_ID = -(1 << 63)  # stands for a missing page_id as a key
# Field names and line ends of the WARC 1.1 format.
VERSION, END = "WARC/1.1", "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is missing."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, folder: str, date: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write both tables below `folder`. `date` is the capture date of all records, as in 2024-01-01T00:00:00Z."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("_page", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)))
    # digests alone are shuffled; a hot payload shrinks to one row for each task before that
    owners = rows.groupBy("digest").agg(F.min("page_id").alias("owner"))
    owned = owners.select("digest", F.coalesce(F.col("owner").cast("long"), F.lit(NO_ID)).alias("_page"))
    # both key columns, so that the copies of a payload are spread by their page_id; repeated rows meet there without another shuffle
    first = rows.select("digest", "_page", "payload").join(owned, ["digest", "_page"], "left_semi").dropDuplicates(["digest", "_page"])
    first.select("digest", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    revisit = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner")))),
        _line("Content-Type", F.when(~revisit, F.lit("text/html; charset=utf-8"))),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(END),
    )
    light = rows.select("page_id", "url", "digest", "size").join(owners, "digest")
    light.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """header, payload (in full, also for revisits), record (the exact bytes: header, body, two line ends), and payload_bytes and payload_digest, measured
    where the payload is read. A payload that does not have the digest it is stored under stops the job.

    Who asks for sizes and digests only joins headers with those; bodies are shuffled only for `payload` and `record`.
    """
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{folder}/headers")
    found = F.sha2("payload", 256)
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), "digest"))
    checked = payloads.select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(found == F.col("digest"), found).otherwise(damaged.cast("string")).alias("payload_digest"),
        F.when(found == F.col("digest"), F.col("payload")).otherwise(damaged.cast("binary")).alias("payload"))
    whole = headers.select("digest", "header").join(checked, "digest")
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return whole.select("header", "payload", F.concat("header", body, F.lit((END * 2).encode())).alias("record"), "payload_bytes", "payload_digest")


def field(name: str) -> Column:
    """A field of the header block, null where it is missing."""
    found = F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: (.*?)\r\n", 1)
    return F.when(found != "", found)


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:page:(.*)>$", 1).try_cast("long")


def summaries(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that were read; sizes and digests are those of the payloads read."""
    return read.select(
        page_of(field("WARC-Record-ID")).alias("page_id"),
        "payload_bytes", "payload_digest",
        field("WARC-Type").alias("record_type"),
        page_of(field("WARC-Refers-To")).alias("refers_to"),
    )
