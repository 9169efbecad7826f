"""WARC as a content-addressed archive.

Two tables make an archive. ``payloads`` holds each payload once, under the SHA-256 of its bytes
(verified when read); ``records`` holds the exact header bytes of each record, in file order,
with that address. Reading joins them, checks the digest and returns the records as they were.
Equal payloads from ``REVISIT_BYTES`` on are one response and revisits that refer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananas.llm.shared import small_side, written

REVISIT_BYTES = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
#: Every record carries this date unless ``date`` is given: archives of one input are equal.
DATE = "2020-01-01T00:00:00Z"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _clean(col: Column) -> Column:
    """A header value may not hold line breaks; they are percent-encoded."""
    return F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) of ``pages`` (page_id, url, html), both written.

    Among equal payloads of ``revisit_bytes`` or more the row with the largest page_id is the response
    (of repeated ids, one row), the others are revisits and carry no payload in their record. A null
    html is an empty payload, a null page_id sorts before all others, a null url is an empty target.
    Other columns are ignored.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha256", F.sha2("payload", 256))
    heads = p.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"))
    heads = written(heads, "heads")
    # the maximum is taken before anything is shuffled; rows with the chosen id count as its ties
    chosen = heads.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("r"), F.count("*").alias("captures"))
    chosen = written(chosen.select("sha256", F.col("r.row").alias("response_row"), F.col("r.page_id").alias("response_id"), "captures"), "chosen")
    # a payload that is captured once is stored as it is scanned; of the others the response's copy is
    again = small_side(written(chosen.filter("captures > 1").select(F.col("sha256").alias("address"), F.col("response_id").alias("keeper")), "repeated"))
    p = p.select("page_id", "sha256", "payload").join(again, F.col("sha256") == F.col("address"), "left")
    bytes_ = F.octet_length("payload").cast("long").alias("length")
    once = p.filter("address is null").select("sha256", bytes_, "payload")
    copies = p.filter(F.col("address").isNotNull() & F.col("page_id").eqNullSafe(F.col("keeper")))
    copies = copies.groupBy("sha256").agg(F.first("payload").alias("payload")).select("sha256", bytes_, "payload")
    payloads = written(once.union(copies), "payloads")

    r = heads.join(chosen.drop("captures"), "sha256")
    revisit = (F.col("length") >= revisit_bytes) & (F.col("row") != F.col("response_row"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("response_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")
    records = written(r.select("row", "sha256", header.alias("header")), "records")
    return records, payloads


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """The records as they were: row, header, body (bytes after the header), payload and its digests.

    Every stored payload is hashed again; one that differs from its address fails the job.
    """
    sound = F.sha2("payload", 256) == F.col("sha256")
    stored = payloads.select("sha256", "length", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("sha256")))).alias("payload"))
    stored = stored.withColumn("sha1", F.sha1("payload"))
    r = records.join(stored, "sha256").withColumn("head", F.decode("header", "UTF-8"))
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return r.select("row", "header", "head", body.alias("body"), "payload", "length", "sha1")


def record_bytes() -> Column:
    """A record as it stands in a WARC file, from the columns of ``read_archive``."""
    return F.concat(F.col("header"), F.col("body"), F.encode(F.lit(CRLF + CRLF), "UTF-8"))


def field(name: str) -> Column:
    """A header field of ``head``, null if absent."""
    found = F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.instr("head", f"{CRLF}{name}: ") > 0, found)


def archive_index(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Per record, from the archive alone: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Every record is put together again by ``read_archive``; length and digest are computed from the
    payload that it was joined with. Fails if a header's digest or its Content-Length isn't that of them.
    """
    r = read_archive(records, payloads).withColumn("sha1", F.sha1("payload"))
    told = F.substring_index(field("WARC-Payload-Digest"), ":", -1)
    size = field("Content-Length")
    digest = F.when(~told.eqNullSafe(F.col("sha1")), F.raise_error(F.concat(F.lit("header and payload differ: "), F.coalesce(told, F.lit("none")))))
    digest = digest.when(~size.eqNullSafe(F.octet_length("body").cast("string")), F.raise_error(F.concat(F.lit("body differs from its header: "), F.coalesce(size, F.lit("none"))))).otherwise(F.col("sha1"))
    number = lambda name: F.expr(f"try_cast(regexp_extract(head, '\\\\r\\\\n{name}: <urn:page:(-?[0-9]+)>', 1) as bigint)")
    return r.select(number("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("url"))
