"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header bytes of every record are stored apart, with the
digest of their payload. Joining the two on the digest gives the original records back, byte for byte. Equal payloads of
at least MIN_REVISIT bytes have one response record, that of the largest page_id; the others are revisit records, whose
payload is found over the response they refer to. Payloads are grouped by digest and bytes, and two payloads under one
digest stop the job; on reading, every payload is hashed again.

Responses and revisits are both rebuilt by records(). A record's name has its page, its url's hash, its payload's digest
and a number, as page_id may repeat.

Defined results: a null html is an empty payload; a null url is written as urn:x-page:ID; of rows that repeat page_id and a
large payload one is the response, that of the first url; a payload of any length is stored whole; an empty table gives empty
archives; further columns are ignored. Everything runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, join_hot, materialize, new_path, repeated

MIN_REVISIT = 1000
_BREAK = "\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables are: payloads (digest, payload) and headers (digest, header, response, uses)."""

    payloads: str
    headers: str
    records: int


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _record_id(page: Column, url: Column, digest: Column, nth: Column) -> Column:
    """A name of its own for each record, also where page_id repeats: page/url's hash-payload's digest-number."""
    return F.concat(F.coalesce(page.cast("string"), F.lit("none")), F.lit("/"), F.substring(F.sha1(F.coalesce(url, F.lit(""))), 1, 12), F.lit("-"), F.lower(F.substring(F.hex(digest), 1, 16)), F.lit("-"), nth.cast("string"))


def _header(page: Column, url: Column, kind: Column, own: Column, refers: Column, sha1: Column, size: Column) -> Column:
    """WARC and HTTP header of a record, in ASCII. A response's block is the HTTP header and the payload, a revisit's the HTTP header."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(_BREAK))
    block = F.char_length(http) + F.when(kind == "response", size).otherwise(F.lit(0))
    name = F.coalesce(page.cast("string"), F.lit("none"))
    # a URL with anything but printable ASCII is written in percent, so that the header stays ASCII and in its line
    target = F.coalesce(F.when(url.rlike(r"^[\x21-\x7E]+$"), url).otherwise(F.url_encode(url)), F.concat(F.lit("urn:x-page:"), name))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:x-page:"), own, F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), sha1,
        F.when(kind == "revisit", F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), refers, F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(_BREAK), http,
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Writes a record per row of pages."""
    spark = pages.sparkSession
    rows = columns(pages, page_id=(id_col, "long"), url=(url_col, None), payload=(payload_col, None)).withColumn("payload", _bytes(F.coalesce("payload", F.lit("")))).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    archive = new_path(spark, "warc")
    stored = rows.groupBy("digest", "payload").agg(F.count("*").alias("copies"), F.max("page_id").alias("last_id"))
    stored = stored.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    stored.write.parquet(f"{archive}/payloads")
    stored = spark.read.parquet(f"{archive}/payloads").drop("payload")
    if stored.groupBy("digest").count().filter("count > 1").limit(1).count():
        raise ValueError("two payloads have one SHA-256 digest")
    total = stored.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # rows that repeat page_id and payload are numbered; the first row of the largest page_id is the response
    kept = materialize(rows.drop("payload").groupBy("page_id", "url", "digest").agg(F.count("*").alias("n")), "records")
    named = join_hot(kept, stored, ["digest"], "copies", total)
    first = F.col("page_id").eqNullSafe(F.col("last_id"))
    by_url = F.col("url").eqNullSafe(F.col("first_url"))
    large = F.col("bytes") >= MIN_REVISIT
    ties = named.filter(large & first).groupBy("digest").agg(F.min("url").alias("first_url"), F.max("copies").alias("of"))
    named = named.filter(~large).withColumn("first_url", F.lit(None).cast("string")).unionByName(join_hot(named.filter(large), ties, ["digest"], "of", total).drop("of"))
    named = repeated(named, "n", "nth")
    kind = F.when(~large | (first & by_url & (F.col("nth") == 0)), "response").otherwise("revisit")
    named = named.withColumn("kind", kind)
    own = _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("nth"))
    refers = _record_id(F.col("last_id"), F.col("first_url"), F.col("digest"), F.lit(0))
    headers = named.select("digest", _bytes(_header(F.col("page_id"), F.col("url"), F.col("kind"), own, refers, F.col("sha1"), F.col("bytes"))).alias("header"), (F.col("kind") == "response").alias("response"))
    headers.write.parquet(f"{archive}/headers")
    return Archive(f"{archive}/payloads", f"{archive}/headers", total)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """All records as they were written: digest, response, record (header, a response's payload, and the closing line breaks)."""
    revisits = spark.read.parquet(archive.headers).filter("not response").select("digest", F.lit(False).alias("response"), F.concat("header", _bytes(F.lit(_BREAK))).alias("record"))
    return response_records(spark, archive).select("digest", F.lit(True).alias("response"), "record").unionByName(revisits)


def response_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The response records: digest, record. Payloads come to their headers by a join on the digest."""
    stored = spark.read.parquet(archive.payloads)
    headers = spark.read.parquet(archive.headers).filter("response").select("digest", "header")
    # only payloads under MIN_REVISIT bytes have several responses: what join_hot sends by broadcast is small
    stored = stored.select("digest", "payload", F.when(F.col("bytes") < MIN_REVISIT, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("uses"))
    return join_hot(headers, stored, ["digest"], "uses", archive.records).select("digest", F.concat("header", "payload", _bytes(F.lit(_BREAK))).alias("record"))


def _field(header: Column, name: str, value: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: {value}\r\n", 1)


def _page(found: Column) -> Column:
    return F.when(found != "none", found.cast("long"))


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record: page_id, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Response records are put together and parsed; a revisit gets the size and digest of the payload it refers to.
    """
    parsed = response_records(spark, archive).withColumn("text", F.col("record").cast("string"))
    head = F.substring_index("text", _BREAK, 1)
    parsed = parsed.select("digest", "record", F.concat(head, F.lit("\r\n")).alias("head"), F.substring_index("text", _BREAK, 2).alias("heads"))
    payload = r"""substring(record, octet_length(heads) + 5,
        cast(regexp_extract(head, '\\r\\nContent-Length: ([0-9]+)\\r\\n', 1) AS int) - (octet_length(heads) - octet_length(head) + 2))"""
    parsed = parsed.select("digest", "head", F.expr(payload).alias("payload"))
    sha1 = F.sha1("payload")
    bad = F.raise_error(F.lit("a payload does not have the digest in its header")).cast("string")
    good = (sha1 == _field(F.col("head"), "WARC-Payload-Digest", "sha1:([0-9a-f]+)")) & (F.unhex(F.sha2("payload", 256)) == F.col("digest"))
    responses = parsed.select(
        _page(_field(F.col("head"), "WARC-Record-ID", "<urn:x-page:([^/>]*)/[^>]*>")).alias("page_id"),
        "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(good, sha1).otherwise(bad).alias("payload_digest"),
        _field(F.col("head"), "WARC-Type", "([a-z]+)").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    stored = spark.read.parquet(archive.payloads).filter(F.col("bytes") >= MIN_REVISIT).select("digest", "copies", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    again = records(spark, archive).filter("not response").select("digest", F.col("record").cast("string").alias("head"))
    found = join_hot(again, stored, ["digest"], "copies", archive.records)
    bad = F.raise_error(F.lit("a revisit refers to a payload with another digest")).cast("string")
    revisits = found.select(
        _page(_field(F.col("head"), "WARC-Record-ID", "<urn:x-page:([^/>]*)/[^>]*>")).alias("page_id"),
        F.lit(None).cast("binary").alias("payload"), "payload_bytes", F.when(F.col("payload_digest") == _field(F.col("head"), "WARC-Payload-Digest", "sha1:([0-9a-f]+)"), F.col("payload_digest")).otherwise(bad).alias("payload_digest"),
        _field(F.col("head"), "WARC-Type", "([a-z]+)").alias("record_type"), _page(_field(F.col("head"), "WARC-Refers-To", "<urn:x-page:([^/>]*)/[^>]*>")).alias("refers_to"),
    )
    return responses.unionByName(revisits)
