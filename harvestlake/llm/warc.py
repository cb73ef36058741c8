"""Content-addressed web archive: payload bytes once by strong digest, exact record headers apart.

``write_archive`` stores two tables in a folder: ``headers`` has one row per record with the exact
bytes of its WARC and HTTP header blocks, ``payloads`` has each distinct payload once under its
SHA-256.  ``read_archive`` checks every stored payload against its digests and joins the two;
``records`` puts the original record bytes together again.

Defined cases: a null payload is an empty one; of records with equal payloads of at least
``min_bytes`` bytes those with the smallest page id are responses and the others revisit it, so a
row that is repeated with that id is a response each time; null ids count as larger than any id;
a null address becomes an empty ``WARC-Target-URI``; an empty table gives an empty archive;
further columns of the input are not archived.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlake.llm.common import payload
from harvestlake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Fixed values of the format.
CRLF = "\r\n"
BASE32_FROM = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits are four groups of 40 bits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), BASE32_FROM, BASE32_TO)


@F.pandas_udf(T.BinaryType())
def _pack(data: pd.Series) -> pd.Series:
    return data.map(lambda x: zlib.compress(bytes(x), 3))


@F.pandas_udf(T.BinaryType())
def _unpack(address: pd.Series, packed: pd.Series) -> pd.Series:
    """Payload bytes, checked against their address."""

    def one(a, z):
        raw = zlib.decompress(bytes(z))
        if hashlib.sha256(raw).hexdigest() != a:
            raise ValueError(f"payload {a} does not have its digest")
        return raw

    return pd.Series([one(a, z) for a, z in zip(address, packed, strict=True)], dtype=object)


def _record_id(page: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def plan_records(pages: DataFrame, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", body: str = "html") -> DataFrame:
    """One narrow row per record: digests, record type, the id it refers to and the exact header bytes."""
    facts = pages.select(
        "page_id",
        "url",
        F.sha2(payload(body), 256).alias("address"),
        base32_sha1(payload(body)).alias("payload_digest"),
        F.octet_length(payload(body)).cast("bigint").alias("payload_bytes"),
    )
    firsts = facts.groupBy("address").agg(F.min("page_id").alias("first_id"))
    joined = facts.join(firsts, "address")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("payload_bytes") < F.lit(min_bytes))
    typed = joined.select(
        "page_id", "url", "address", "payload_digest", "payload_bytes",
        F.when(is_first, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        F.when(~is_first, F.col("first_id")).alias("refers_to"),
    )
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    fields = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("url")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}X-Refers-To-Page: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF * 2),
    )
    return typed.withColumn("header", F.concat(fields, http).cast("binary"))


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, body: str = "html") -> None:
    """Write ``headers`` and ``payloads`` below ``folder``, which all executors must share.

    Only digests are grouped; a payload moves once, compressed, to meet the id that keeps it.
    """
    planned = plan_records(pages, min_bytes, body=body)
    planned.select("page_id", "address", "header").write.option("compression", "zstd").parquet(f"{folder}/headers")
    keepers = (
        pages.select(F.col("page_id"), F.sha2(payload(body), 256).alias("address"))
        .groupBy("address")
        .agg(F.min("page_id").alias("first_id"))
    )
    bodies = pages.select("page_id", F.sha2(payload(body), 256).alias("address"), _pack(payload(body)).alias("packed"))
    kept = bodies.join(keepers, (bodies["address"] == keepers["address"]) & bodies["page_id"].eqNullSafe(keepers["first_id"]), "left_semi")
    once = kept.dropDuplicates(["address", "page_id"]).select("address", "packed")
    once.write.option("compression", "none").parquet(f"{folder}/payloads")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``address`` and the checked ``payload`` bytes."""
    return spark.read.parquet(f"{folder}/payloads").select("address", _unpack("address", "packed").alias("payload"))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The records with the fields parsed from their exact header bytes."""
    rows = spark.read.parquet(f"{folder}/headers")
    text = F.split(F.col("header").cast("string"), "\r\n\r\n", 2)[0]
    text = F.concat(text, F.lit(CRLF))
    return rows.select(
        "page_id", "address", "header",
        _field(text, "WARC-Type").alias("record_type"),
        _field(text, "WARC-Target-URI").alias("url"),
        F.substring_index(_field(text, "WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        _field(text, "X-Refers-To-Page").cast("bigint").alias("refers_to"),
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the facts of its full payload, as read back; a wrong digest fails the job."""
    bodies = read_payloads(spark, folder).select(
        "address", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("_digest")
    )
    joined = read_headers(spark, folder).join(bodies, "address", "left")
    checked = F.when(F.col("payload_digest") == F.col("_digest"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("record without its payload: "), F.col("address")))
    )
    return joined.select("page_id", "url", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The original record bytes: header blocks, then the payload unless the record is a revisit."""
    joined = read_headers(spark, folder).join(read_payloads(spark, folder), "address", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", "record_type", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")
