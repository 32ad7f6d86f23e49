"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, original records by joining the two.

An archive is two tables in the shared folder: `headers` (page_id, digest, header), the header's exact bytes up to and with its
blank line, and `payloads` (digest, payload), one row per digest. Reading back joins them, takes the SHA-256 of every payload again
and fails on any that does not match its address, puts the records together byte by byte and reads their fields from those bytes.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: From so many bytes on, an equal payload is recorded as a revisit.
REVISIT_BYTES = 100
NEWLINE = "\r\n"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def _header(kind: Column, page_id: Column, url: Column, digest: Column, n: Column, refers_to: Column, date: str) -> Column:
    """The header block of a record. Control characters of a url are percent-encoded, so they can't end the line."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{NEWLINE}WARC-Type: "), kind,
        F.lit(f"{NEWLINE}WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">{NEWLINE}WARC-Date: {date}{NEWLINE}WARC-Target-URI: "), safe,
        F.lit(f"{NEWLINE}WARC-Payload-Digest: sha256:"), digest,
        F.when(revisit, F.concat(
            F.lit(f"{NEWLINE}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{NEWLINE}WARC-Refers-To: <urn:page:"),
            F.coalesce(refers_to.cast("string"), F.lit("")), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{NEWLINE}Content-Type: text/html{NEWLINE}Content-Length: "), F.when(revisit, F.lit(0)).otherwise(n).cast("string"),
        F.lit(NEWLINE * 2))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write one record per row of `pages`; returns where the two tables are.

    A null payload is empty. Of the rows with one payload of `REVISIT_BYTES` bytes or more, that with the smallest id is the
    response (rows that repeat that id too; rows without an id only where none has one); the others revisit it. `date` stands for
    the capture time, which the table lacks. Other columns are left out; an empty table makes an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    marked = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"))
    first = marked.groupBy("digest").agg(F.min("page_id").alias("first"))
    kind = F.when((F.col("n") < REVISIT_BYTES) | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    archive = Archive(scratch(spark, "warc-headers"), scratch(spark, "warc-payloads"))
    header = _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("n"), F.col("first"), date).cast("binary")
    marked.join(first, "digest").withColumn("kind", kind).select("page_id", "digest", header.alias("header")).write.parquet(archive.headers)
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, payload_digest, payload, record): every record as its original bytes, and the full payload that it stands for."""
    payloads = spark.read.parquet(archive.payloads)
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    joined = spark.read.parquet(archive.headers).join(payloads.select("digest", verified.alias("payload")), "digest")
    block = F.when(_field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("page_id", F.col("digest").alias("payload_digest"), "payload", F.concat("header", block, F.lit((NEWLINE * 2).encode())).alias("record"))


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header.cast("string"), rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)


def read_index(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the records as read back; refers_to is null but for revisits."""
    head = F.element_at(F.split(F.decode("record", "UTF-8"), NEWLINE * 2, 2), 1)
    records = read_archive(spark, archive).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.concat(head, F.lit(NEWLINE)).alias("head"))
    refers = F.regexp_extract(_field(F.col("head"), "WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    return records.select(
        "page_id", "payload_bytes", F.regexp_extract(_field(F.col("head"), "WARC-Payload-Digest"), "^sha256:(.*)$", 1).alias("payload_digest"),
        _field(F.col("head"), "WARC-Type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"))
