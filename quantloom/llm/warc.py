"""Content-addressed WARC archives: every distinct payload stored once, headers kept apart.

``write_archive`` gives each page a WARC record. Payloads are addressed by SHA-256 and verified
byte for byte: of the records with one payload, the one with the largest page id is a
``response`` that holds the bytes, the others are ``revisit`` records that refer to it by record
id (the identical-payload-digest profile). The exact header of every record is also kept in a
table of its own. ``read_archive`` parses the files, and ``restore`` rebuilds every original
page's payload by joining revisits to their responses and records to their headers.

Files are written by Spark's text writer with the WARC record end as line separator, so they go
to any file system Spark can write, through its commit protocol; they are read back as whole
files, and each file holds about ``file_bytes`` of payload.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.hot import salted_join
from quantloom.session import materialise

# Fixed values of the formats: RFC 4648 base32 letters, WARC 1.1 names and the revisit profile.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.0"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

FILE_BYTES = 32 << 20  # payload bytes a file holds, about
DATE = "2026-01-01T00:00:00Z"  # capture date written when the table gives none

ARCHIVE_SCHEMA = "record_id string, warc_type string, refers_to string, head string, payload binary, file string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1 (32 letters, no padding)."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(8):  # 5 hex digits are 20 bits, 4 letters of 5 bits
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("long")
        for k in range(4):
            at = F.shiftright(value, 15 - 5 * k).bitwiseAND(31) + 1
            letters.append(F.substr(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def _record_id(seq: Column) -> Column:
    h = F.md5(F.concat(F.lit("warc-record:"), seq.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _head(fields: list[tuple[str, Column]]) -> Column:
    """Version line and fields, each line ending in CRLF; a null field is left out."""
    lines = [F.lit(VERSION)] + [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write one WARC record per row of ``pages`` under ``path``; return the stored header table.

    Payload: the html in UTF-8, null as empty. Records with byte-equal payloads form a group
    (empty payloads too); the one with the largest id is the response (null ids rank below all
    others; among repeated rows with that id, the first read), all others revisit it, with
    ``refers_to`` its id. A SHA-256 shared by different bytes stops the job with an error.
    Header table columns: seq, record_id, page_id, record_type, refers_to, refers_to_record,
    payload_sha256, payload_bytes, payload_digest, head. An empty table writes no record.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("seq"),
        F.col(id_col).cast("bigint").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_sha256", F.sha2("payload", 256))
    narrow = materialise(
        rows.select(
            "seq",
            "page_id",
            "url",
            "payload_sha256",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
        ),
        "warc-records",
    )
    rank = F.struct(
        F.col("page_id").isNotNull().alias("known"),
        F.coalesce("page_id", F.lit(0)).alias("id"),
        (-F.col("seq")).alias("first"),
        "page_id",
        "url",
    )
    groups = materialise(
        narrow.groupBy("payload_sha256").agg(F.count("*").alias("n"), F.max(rank).alias("top")).select(
            "payload_sha256",
            "n",
            (-F.col("top.first")).alias("top_seq"),
            F.col("top.page_id").alias("top_page"),
            F.col("top.url").alias("top_url"),
        ),
        "warc-groups",
    )
    placed = salted_join(narrow, groups, ["payload_sha256"], "n", F.xxhash64("seq"))
    response = F.col("seq") == F.col("top_seq")
    kind = F.when(response, "response").otherwise("revisit")
    http_head = F.concat(F.lit(HTTP_HEAD), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block_bytes = F.octet_length(http_head) + F.when(response, F.col("payload_bytes")).otherwise(0)
    headed = placed.select(
        "seq",
        _record_id(F.col("seq")).alias("record_id"),
        "page_id",
        kind.alias("record_type"),
        F.when(~response, F.col("top_page")).alias("refers_to"),
        F.when(~response, _record_id(F.col("top_seq"))).alias("refers_to_record"),
        "payload_sha256",
        "payload_bytes",
        "payload_digest",
        "url",
        "top_url",
        block_bytes.alias("block_bytes"),
    )
    revisit = F.col("record_type") == "revisit"
    head = _head(
        [
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.col("refers_to_record")),
            ("WARC-Refers-To-Target-URI", F.when(revisit, F.col("top_url"))),
            ("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.col("block_bytes").cast("string")),
        ]
    )
    headers = materialise(headed.withColumn("head", head).drop("url", "top_url", "block_bytes"), "warc-headers")

    # Payload bytes once per SHA-256, one copy a map task; a record whose own SHA-1 differs from
    # that of the bytes stored under its address fails ``restore``.
    store = rows.groupBy("payload_sha256").agg(F.any_value("payload").alias("payload"))
    responses = headers.where("record_type = 'response'").join(store, "payload_sha256")
    http = F.concat(F.lit(HTTP_HEAD), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    text = F.concat(F.col("head"), F.lit("\r\n"), http)
    out = responses.select(F.concat(text, F.col("payload").cast("string")).alias("value")).unionByName(
        headers.where("record_type = 'revisit'").select(text.alias("value"))
    )
    stored, records = headers.agg(
        F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes"))), F.count("*")
    ).first()
    per_file = max(1, file_bytes * records // max(1, (stored or 0) + 512 * records))  # 512: a head, about
    # Files follow the partitions of the join (no further shuffle); a file rolls over at the
    # number of records that hold about ``file_bytes`` on average.
    (
        out.write.mode("overwrite")
        .option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )
    return headers


def parse_records(data: bytes) -> Iterator[tuple[str, str, str | None, str, bytes | None]]:
    """``(record_id, type, refers_to, head, payload)`` of every record of one WARC file.

    The head is the version line and the fields, each with its CRLF; a record's block is read
    by its Content-Length, so payload bytes may hold anything. The payload of a response is the
    HTTP body; a revisit has none.
    """
    at, end = 0, len(data)
    while at < end:
        stop = data.index(b"\r\n\r\n", at)
        head = data[at : stop + 2].decode("utf-8")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:-1])
        size = int(fields["Content-Length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) != size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError("WARC record cut short")
        kind = fields["WARC-Type"]
        payload = None
        if kind == "response":
            body = block.index(b"\r\n\r\n") + 4
            payload = block[body:]
        yield fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), head, payload
        at = stop + 8 + size


def _parse_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            data = gzip.decompress(content) if path.endswith(".gz") else content
            found = list(parse_records(data))
            made = pd.DataFrame(found, columns=["record_id", "warc_type", "refers_to", "head", "payload"])
            made["file"] = path
            yield made


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive under ``path``, one row each (see ``ARCHIVE_SCHEMA``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(_parse_files, ARCHIVE_SCHEMA)


def restore(archive: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per original page: page_id, record_type, refers_to, payload, payload_bytes, payload_digest.

    Records meet their stored headers by record id (a record whose head differs from the stored
    one fails the job), and revisits take the payload of the response they name. Length and
    SHA-1 are taken again from the restored bytes, next to each response's payload as it is
    parsed; a record whose own SHA-1 (from its page's bytes, in its head) differs from that of
    the bytes it gets fails the job, so a SHA-256 shared by unequal payloads cannot pass. A
    query that keeps only lengths and digests moves no payload through the joins.
    """
    known = headers.select("record_id", "page_id", "record_type", "refers_to", "payload_digest", F.col("head").alias("stored_head"))
    same = F.when(F.col("head") == F.col("stored_head"), F.lit(True))
    records = (
        archive.withColumnRenamed("refers_to", "refers_to_record")
        .withColumn("found_bytes", F.octet_length("payload").cast("bigint"))
        .withColumn("found_digest", base32_sha1(F.col("payload")))
        .join(known, "record_id")
        .where(same.otherwise(F.raise_error(F.lit("WARC head differs from the stored one"))))
    )
    kept = ["page_id", "record_type", "refers_to", "payload_digest", "payload", "found_bytes", "found_digest"]
    responses = records.where("warc_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), "payload", "found_bytes", "found_digest"
    )
    revisits = records.where("warc_type = 'revisit'")
    counts = revisits.groupBy("refers_to_record").agg(F.count("*").alias("n"))
    filled = salted_join(
        revisits.select("page_id", "record_type", "refers_to", "payload_digest", "refers_to_record", F.xxhash64("record_id").alias("spread")),
        responses.join(counts, "refers_to_record"),
        ["refers_to_record"],
        "n",
        F.col("spread"),
    ).select(*kept)
    whole = records.where("warc_type = 'response'").select(*kept).unionByName(filled)
    checked = F.when(F.col("found_digest") == F.col("payload_digest"), F.col("found_digest"))
    return whole.select(
        "page_id",
        "record_type",
        "refers_to",
        "payload",
        F.col("found_bytes").alias("payload_bytes"),
        checked.otherwise(F.raise_error(F.lit("payload differs from the page's own SHA-1"))).alias("payload_digest"),
    )
