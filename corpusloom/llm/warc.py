"""WARC archive addressed by content.

A payload is stored once, under its SHA-256; record headers are kept apart, exactly as written, with the digest of the
payload they belong to.  Payloads are deflated one by one before they are moved or stored.  Of records with equal payloads the one with the smallest page id is the response, the others are
revisits that name it.  Records are read back by joining headers with payloads, whose digests are recomputed on reading.
Payloads are moved only once, to the place of their digest.
"""

from __future__ import annotations

import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_shuffles, scratch_dir

CRLF = "\r\n"
HEADERS_A_FILE, BYTES_A_FILE = 20_000, 16 << 20
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"  # fixed values: conv()'s digits and RFC 4648's
_RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def deflated(payload: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: zlib.compress(x, 4))

    return run(payload)


def inflated(packed: Column) -> Column:
    """The payload, or null where it can't be unpacked, so that reading reports it as not verified."""

    def unpack(x: bytes) -> bytes | None:
        try:
            return zlib.decompress(x)
        except zlib.error:
            return None

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(unpack)

    return run(packed)


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of a digest in hexadecimal, whose length is a multiple of ten digits."""
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in range(1, 41, 10)]
    return F.translate(F.concat(*parts), _HEX32, _RFC4648)


def _entries(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(pages[payload].cast("string").cast("binary"), F.lit("").cast("binary"))
    made = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"))
    return made.withColumn("sha256", F.sha2("payload", 256))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes path/headers and path/payloads.

    Null payloads count as empty ones, null URLs give a record without WARC-Target-URI, null page ids come last when the
    response is chosen.  Payloads below least_bytes bytes are not shared: such records are all responses.  Of rows with
    equal id and payload one is the response, the others revisit it.
    """
    entries = _entries(pages, page_id, url, payload)
    narrow = entries.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("sha1"), F.monotonically_increasing_id().alias("row"))
    narrow.write.parquet(f"{path}/entries")
    spark = pages.sparkSession
    narrow = spark.read.schema(narrow.schema).parquet(f"{path}/entries")
    size = narrow.agg(F.count("*").alias("rows"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes")).first()
    files = lambda whole, part: max(1, -(-whole // part))  # noqa: E731  so that an archive isn't many small files
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    firsts = narrow.groupBy("sha256").agg(F.min(order).alias("first"))
    rows = narrow.join(firsts, "sha256")
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("row") != F.col("first.row"))
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    identity = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(_VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", identity(F.col("page_id"), F.col("row"))),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", identity(F.col("first.id"), F.col("first.row"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )
    rows.select("page_id", "row", header.cast("binary").alias("header"), "sha256").coalesce(files(size["rows"], HEADERS_A_FILE)).write.parquet(f"{path}/headers")
    wanted = firsts.select("sha256", F.col("first.id").alias("page_id"))
    stored = entries.select("sha256", "page_id", deflated(F.col("payload")).alias("packed"))
    match = (stored["sha256"] == wanted["sha256"]) & stored["page_id"].eqNullSafe(wanted["page_id"])
    stored.join(wanted, match, "left_semi").dropDuplicates(["sha256"]).select("sha256", "packed").coalesce(files(size["bytes"], BYTES_A_FILE)).write.parquet(f"{path}/payloads")
    forget_shuffles(spark)


def header_field(header: Column, name: str) -> Column:
    """A named field of record headers; null where it is missing."""
    found = F.regexp_extract(header.cast("string"), f"(?im)^{name}:[ \\t]*(.*?)\\r?$", 1)
    return F.when(found == "", F.lit(None)).otherwise(found)


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads")
    return stored.select("sha256", inflated(F.col("packed")).alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: page_id, row, record_type, header and payload (each record's full one), and verified.

    verified tells that the stored payload still has the digests it is filed under and, for responses, the length stated;
    a record whose payload is lost stays, with a null payload and not verified.
    """
    headers = spark.read.schema("page_id long, row long, header binary, sha256 string").parquet(f"{path}/headers")
    stored = _payloads(spark, path)
    stored = stored.withColumn("intact", F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))).withColumn("payload_sha1", base32_of_hex(F.sha1("payload")))
    made = headers.join(stored, "sha256", "left").withColumn("intact", F.coalesce("intact", F.lit(False)))
    kind = header_field(F.col("header"), "WARC-Type")
    stated = header_field(F.col("header"), "Content-Length").cast("long")
    ok = F.col("intact") & (header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_sha1"))) & ((kind != "response") | (stated == F.octet_length("payload")))
    return made.select("page_id", "row", kind.alias("record_type"), "header", "payload", F.coalesce(ok, F.lit(False)).alias("verified"))


def verified(records: DataFrame) -> DataFrame:
    """The records without verified, as long as all are; one that is not ends the job."""
    what = F.concat(F.lit("the archive's record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" is damaged"))
    checked = F.when(F.col("verified"), F.col("record_type")).otherwise(F.raise_error(what).cast("string"))
    return records.withColumn("record_type", checked).drop("verified")


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the record as it stands in a WARC file: header, block (none for revisits), two line ends."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return records.select("page_id", "row", F.concat("header", block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, read from the archive: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Records whose payload is lost stay, with nulls and not verified.

    Payloads are read once, where they are stored; their lengths and digests, not they, are joined with the headers.
    """
    stored = _payloads(spark, path)
    stored = stored.select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False)).alias("intact"))
    headers = spark.read.schema("page_id long, row long, header binary, sha256 string").parquet(f"{path}/headers")
    field = lambda name: header_field(F.col("header"), name)
    headers = headers.select("page_id", "sha256", field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("stated"), field("Content-Length").cast("long").alias("length"), F.expr("nullif(regexp_extract(string(header), 'WARC-Refers-To: <urn:page:(-?[0-9]+):', 1), '')").cast("long").alias("refers_to"))
    made = headers.join(stored, "sha256", "left").withColumn("intact", F.coalesce("intact", F.lit(False)))
    ok = F.col("intact") & (F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & ((F.col("record_type") == "revisit") | (F.col("length") == F.col("payload_bytes")))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce(ok, F.lit(False)).alias("verified"))


def new_archive(spark: SparkSession) -> str:
    """A fresh archive path in the shared folder."""
    return f"{scratch_dir(spark)}/archive-{uuid.uuid4().hex[:8]}"
