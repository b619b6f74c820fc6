"""WARC records as a content-addressed archive: payload bytes once, under a verified strong digest; record headers apart."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

#: The digits of base 32 as conv() writes them and as RFC 4648 does.
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: four runs of 40 bits, eight digits each, all by built-in functions."""
    digest = F.sha1(payload)
    runs = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*runs), BASE32_FROM, BASE32_TO)


def escape(url: Column) -> Column:
    """A url on one line, reversibly: a backslash is doubled, line ends become \\r and \\n."""
    return F.replace(F.replace(F.replace(url, F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def unescape(line: Column) -> Column:
    parts = F.split(line, r"\\\\")  # doubled backslashes
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))), "\\")


def record_id(page: Column, url: Column, sha256: Column, copy: Column) -> Column:
    """Records of one page_id differ in url or payload, or in their number among equal ones."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.lower(F.hex(F.xxhash64(url, sha256))), F.lit(":"), copy.cast("string"), F.lit(">"))


def headers(kind: Column, own: Column, url: Column, date: str, digest: Column, refers: Column, length: Column) -> Column:
    """The exact bytes of a record's header block, as text; the block ends with an empty line."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", own),
        line("WARC-Target-URI", escape(url)), line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", refers),
        F.when(kind == "revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF).otherwise(""),
        line("Content-Type", F.lit("text/html")), line("Content-Length", length), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write `path`/payloads (sha256, payload: each once) and `path`/records (page_id, sha256, header).

    pages: page_id, url, html. Of records with equal payloads of at least min_bytes bytes the one with the largest page_id (then the
    largest url) is the response, the others are revisits; smaller ones are all responses, though their bytes are stored once too.
    Null html is the empty payload, a null page_id sorts below all others, of repeated equal rows one is the response and the others
    revisit it, an empty table gives an empty archive.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    keyed.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    slim = keyed.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    # one row for each different (page, url, payload): of equal rows the first is the response, so their number travels along
    rows = slim.groupBy("sha256", "page_id", "url", "n", "sha1").agg(F.count("*").alias("copies"))
    best = rows.groupBy("sha256").agg(F.max(F.struct("page_id", "url")).alias("top")).select(F.col("sha256").alias("_sha"), "top")
    dealt = rows.join(best, F.col("sha256") == F.col("_sha")).withColumn("first", F.struct("page_id", "url").eqNullSafe(F.col("top")))
    each = dealt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    small = F.col("n") < min_bytes
    kind = F.when(small | (F.col("first") & (F.col("copy") == 1)), "response").otherwise("revisit")
    refers = F.when(kind == "revisit", record_id(F.col("top.page_id"), F.col("top.url"), F.col("sha256"), F.lit(1)))
    own = record_id(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy"))
    length = F.when(kind == "revisit", 0).otherwise(F.col("n"))
    each.select("page_id", "sha256", headers(kind, own, F.col("url"), date, F.col("sha1"), refers, length).alias("header")).write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each held against its address: a damaged payload raises an error instead of passing on."""
    store = spark.read.schema("sha256 binary, payload binary").parquet(f"{path}/payloads")
    whole = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return store.select("sha256", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest"))).alias("payload"))


def parse_header(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?dm)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(header.rlike(rf"(?dm)^{name}: "), value)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record as its header says: page_id, url, record_type, refers_to (the page_id there), sha1, length, sha256, header."""
    number = lambda name: F.regexp_extract(parse_header(F.col("header"), name), r"<urn:page:(-?\d+):", 1).try_cast("long")
    rows = spark.read.schema("page_id long, sha256 binary, header string").parquet(f"{path}/records")
    return rows.select(
        number("WARC-Record-ID").alias("page_id"), unescape(parse_header(F.col("header"), "WARC-Target-URI")).alias("url"), parse_header(F.col("header"), "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), F.substring(parse_header(F.col("header"), "WARC-Payload-Digest"), 6, 100).alias("sha1"),
        parse_header(F.col("header"), "Content-Length").cast("long").alias("length"), "sha256", "header",
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The exact bytes of every record: header block, payload (none for a revisit), two line ends. One join on the digest; Spark splits a digest that many records share."""
    records, payloads = read_records(spark, path), read_payloads(spark, path)
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.join(payloads, "sha256").select("page_id", "record_type", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    # what is compared with a record's header, worked out from the stored bytes once for each payload and not for each record
    facts = read_payloads(spark, path).select(F.col("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("stored_sha1"))
    records = read_records(spark, path).join(facts, "sha256")
    right = (F.col("sha1") == F.col("stored_sha1")) & (F.col("length") == F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")))
    digest = F.when(right, F.col("sha1")).otherwise(F.raise_error(F.lit("a record's header doesn't fit its payload")))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS top FROM p),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1), '' ORDER BY i) AS digest FROM (SELECT DISTINCT h FROM p), range(32) AS t(i) GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM r JOIN d USING (h)
"""
