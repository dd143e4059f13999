"""Content-addressed web archive.

``payloads(digest, payload)`` holds each payload once under its SHA-256;
``records(digest, key, header)`` holds the exact head of every WARC record (its
WARC and HTTP lines). A whole record is the join of the two. Of the records with
equal payloads of at least ``least`` bytes the one with the largest id is the
``response``; the others are ``revisit`` records that refer to it. Smaller payloads
are always responses, though stored once too.

Only digests are grouped, so a payload that a third of all pages share costs one
narrow row per page; payloads travel once, to the row that stands for them.
Reading recomputes both digests of each stored payload and fails on a mismatch.

A null payload is an empty one; a null address is empty; line breaks in an address
are percent-encoded. A null id is the smallest id and comes back as null. Rows that
repeat an id and its payload get equal records. Empty tables make empty archives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import NO_ID, as_key, stored

LEAST = 1000  # bytes
EPOCH = "1970-01-01T00:00:00Z"


@dataclass
class Archive:
    records: DataFrame
    payloads: DataFrame


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.when(key == NO_ID, "").otherwise(key.cast("string")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record_head(key: Column, url: Column, sha1: Column, size: Column, response: Column, refers_to: Column, date: str) -> Column:
    """WARC lines and HTTP lines of a record; its block is the HTTP lines and, for a response, the payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(response, size).otherwise(0)
    address = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _urn(key)),
        _line("WARC-Target-URI", address),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(~response, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn(refers_to)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    ).cast("binary")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = EPOCH) -> Archive:
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    whole = pages.select(as_key(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    whole = whole.withColumn("digest", F.sha2("payload", 256))
    facts = stored(whole.select("key", "url", "digest", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("size")), "facts")
    rows = facts.groupBy("digest", "key").agg(F.count("*").alias("n"))
    chosen = stored(rows.groupBy("digest").agg(F.max(F.struct("key", "n")).alias("m")).select("digest", "m.key", "m.n"), "chosen")
    response = (F.col("size") < least) | (F.col("key") == F.col("top"))
    head = record_head(F.col("key"), F.col("url"), F.col("sha1"), F.col("size"), response, F.col("top"), date)
    tops = chosen.select("digest", F.col("key").alias("top"))
    records = stored(facts.join(tops, "digest").select("digest", "key", head.alias("header")), "records")
    texts = whole.select("key", "digest", "payload").join(chosen.drop("n"), ["key", "digest"], "left_semi").select("digest", "payload")
    if not chosen.filter("n > 1").isEmpty():  # the row that stands for a payload is there several times
        texts = texts.dropDuplicates(["digest"])
    return Archive(records, stored(texts, "payloads"))


def read_records(archive: Archive) -> DataFrame:
    """``(key, record_type, refers_to, payload_digest, payload_bytes, header, payload)`` of all records, digests verified.

    ``payload`` is the full payload, of revisits too.
    """
    sha1 = F.sha1("payload")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = archive.payloads.select(
        "digest",
        "payload",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(sound, sha1).otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its digest "), "digest"))).alias("payload_digest"),
    )
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    number = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1)
    id_of = lambda name: F.when(number(name) != "", number(name).cast("long"))
    heads = archive.records.select(
        "digest", "header", id_of("WARC-Record-ID").alias("key"), field("WARC-Type").alias("record_type"), id_of("WARC-Refers-To").alias("refers_to"), F.substring(field("WARC-Payload-Digest"), 6, 40).alias("said")
    )
    both = heads.join(checked, "digest")
    told = F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's header names another digest than its payload has")))
    return both.select("key", "record_type", "refers_to", told.alias("payload_digest"), "payload_bytes", "header", "payload")


def whole_records(archive: Archive) -> DataFrame:
    """``(key, record)``: the bytes of each WARC record as they would stand in a file."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read_records(archive).select("key", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))
