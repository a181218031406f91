"""Content-addressed web archive.

An archive is two tables. ``payloads`` has the bytes of each distinct payload once, under its SHA-256. ``records``
has one row per record: its exact header block, the digest of its payload and the record that it refers to. A record
as first written is the header block, an empty line, the payload and two line ends; joining the two tables by digest
gives it back byte for byte, and its payload is hashed again when it is read.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest id is the response and the
others are revisits; smaller payloads are always responses.

Edge cases: a null payload is empty; null ids count as larger than all others; rows that share the smallest id and the
payload are all responses; a null url gives an empty target; line ends in a url are percent-encoded; an empty table gives
an empty archive. A record whose header or payload is damaged is read with an error and a null digest: it stops no other.
Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table

MIN_REVISIT = 100
CRLF = "\r\n"


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of pages under path.

    Two shuffles carry payload digests and ids, one the payload of each digest's first record; none carries the copies.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    keys = rows.select("id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    # one payload per digest and input task leaves the map side: first() is combined there
    rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    keys.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first_id")).write.parquet(f"{path}/firsts")
    firsts = spark.read.schema("digest string, first_id long").parquet(f"{path}/firsts")
    # both sides are exchanged, so a digest that a third of the records share is split between tasks
    joined = keys.join(firsts.hint("merge"), "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    name = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), kind, F.lit(CRLF + "WARC-Record-ID: "), name(F.col("id")),
        F.lit(CRLF + "WARC-Target-URI: "), F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(CRLF + f"WARC-Date: {date}"),
        F.lit(CRLF + "WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), name(F.col("first_id")))).otherwise(""),
        F.lit(CRLF + "Content-Length: "), F.col("bytes").cast("string"),
    )
    joined.select("digest", head.cast("binary").alias("header")).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's original records: (record binary, digest string)."""
    records = spark.read.schema("digest string, header binary").parquet(f"{path}/records")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    record = F.concat("header", F.lit((CRLF * 2).encode()), "payload", F.lit((CRLF * 2).encode()))
    return records.join(payloads.hint("merge"), "digest", "left").select("digest", record.alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, record_type, refers_to, payload, payload_digest, error) of WARC record bytes, each verified.

    The payload is cut out by the length that the header states and must have the digest that the header states. error
    says what is wrong, null for a good record; a record with an error has no digest.
    """
    # a header block is ASCII but for the target; Latin-1 keeps one character per byte
    text = records.select("record", F.decode("record", "ISO-8859-1").alias("t")).select("record", F.locate(CRLF * 2, "t").alias("cut"), F.col("t"))
    head = text.select("record", "cut", F.decode(F.expr("substring(record, 1, cut - 1)"), "UTF-8").alias("head"))
    field = lambda k: F.regexp_extract("head", rf"(?md)^{k}: (.*?)\r?$", 1)
    out = head.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("rid"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Refers-To").alias("ref"),
        F.expr("substring(record, cut + 4, try_cast(regexp_extract(head, '(?md)^Content-Length: ([0-9]+)', 1) as int))").alias("payload"), field("WARC-Payload-Digest").alias("stated"),
    )
    out = out.withColumn("payload_digest", F.sha2("payload", 256))
    number = lambda c: F.try_to_number(F.nullif(F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    good = F.coalesce(F.col("stated") == F.concat(F.lit("sha256:"), F.col("payload_digest")), F.lit(False))
    error = F.when(F.col("payload").isNull(), "no payload length").when(~good, "payload digest mismatch")
    return out.select(number(F.col("rid")).alias("record_id"), "target_uri", "record_type", number(F.col("ref")).alias("refers_to"), "payload", F.when(good, F.col("payload_digest")).alias("payload_digest"), error.alias("error"))


def export_warc(records: DataFrame, path: str) -> None:
    """Write record bytes as plain .warc text parts. A record ends with two line ends, so they serve as separator."""
    body = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string")
    records.select(body.alias("value")).write.option("lineSep", CRLF * 2).text(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages to an archive, read it back and report each record."""
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    r = parse_records(read_archive(spark, path))
    return r.select(F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE_OP1 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
