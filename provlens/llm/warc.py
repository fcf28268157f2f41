"""Operator 8: WARC archives in which later copies of a payload revisit the first."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.llm.common import landed, shared_path

LEAST = 100  # bytes from which equal payloads are deduplicated

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Decide for each (page_id, digest) whether it is a response or a revisit.

    Only headers travel: id, digest and size. Copies are counted before the shuffle, and
    the join with the first copy may split a digest that a large part of the pages share.
    """
    headers = (pages.select("page_id", F.sha2("payload", 256).alias("payload_digest"),
                            F.length("payload").cast("long").alias("payload_bytes"))
               .groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count("*").alias("_rows")))
    first = (headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
             .agg(F.min("page_id").alias("original"), F.count("*").alias("_ids")))
    # A payload met under one id only has nothing to refer to.
    first = first.filter("_ids > 1 AND original IS NOT NULL").drop("_ids")
    resolved = headers.join(first, "payload_digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original")) \
        & (F.col("payload_bytes") >= least)
    return resolved.select(
        "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def _record(date: str) -> Column:
    """A record without the two line breaks that end it."""
    page = F.concat(F.lit(PAGE_URN), F.col("page_id").cast("string"))
    # A header is one line: control characters and blanks of a URL are escaped.
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    target = F.coalesce(F.when(url != "", url), page, F.lit(PAGE_URN + "none"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(F.col("html"), F.lit(""))))
    identity = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.substring(F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url"), F.col("payload_digest"),
                                       F.lit(date)), 256), 1, 32),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", identity),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block)


def write(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write a record per page to gzip-compressed WARC files in ``folder``.

    Needs ``page_id``, ``url`` and ``html``; other columns are not looked at. The payload is
    the html in UTF-8 (null: empty). Of equal payloads of at least ``least`` bytes the one
    with the smallest page id is the response; a repeated row shares the fate of its id. A
    page without an id is always a response. A file holds what one task was dealt.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                         F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    fate = resolve(pages, least)
    # Responses that equal no other page need no join: only the ids that do are looked up.
    digest = F.sha2("payload", 256)
    keyed = pages.withColumn("payload_digest", digest).withColumn("payload_bytes", F.length("payload").cast("long"))
    revisits = fate.filter("record_type = 'revisit'").select(
        F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to")
    joined = keyed.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")),
                        "left")
    joined = joined.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), F.lit("revisit"))
                               .otherwise(F.lit("response")))
    # Spark ends each text row with the separator, here the one that ends a WARC record.
    (joined.select(_record(date).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").text(folder))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, by the lengths that headers give."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, data[begin:end]
        at = end + 4


def expanded(data: bytes, step: int = 1 << 16) -> bytes:
    """All members of a gzip file; archives from elsewhere have one for each record."""
    out, member = [], zlib.decompressobj(31)
    for at in range(0, len(data), step):
        piece = data[at:at + step]
        while piece:
            if member.eof:
                member = zlib.decompressobj(31)
            out.append(member.decompress(piece))
            piece = member.unused_data if member.eof else b""
    if data and not member.eof:
        raise ValueError("archive is cut off")
    return b"".join(out)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per response and revisit record of the archives in ``folder``; other records are passed over.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest as the header and the
    HTTP head give them, stored_digest (recomputed; null for revisits) and payload (null for revisits).
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "stored_digest",
                 "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(expanded(data.as_py())):
                    if fields.get("WARC-Type") not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                    full = fields["WARC-Type"] == "response"
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023,E731
                    rows.append((number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                                 number("X-Refers-To-Page-ID"), length,
                                 fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                                 hashlib.sha256(payload).hexdigest() if full else None, payload if full else None))
                    held += len(payload)
                    if held > 8_000_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
              "payload_digest string, stored_digest string, payload binary")
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    return files.mapInArrow(records, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Join revisits to the responses they refer to; adds ``resolves`` and drops the payload.

    Responses resolve when what is stored has the digest and size of the header; revisits
    when the response they name exists with the same digest. No payload is shuffled.
    """
    rows = landed(records.withColumn("stored_bytes", F.length("payload")).drop("payload"), "warc-headers")
    targets = (rows.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
               .join(rows.filter("record_type = 'response'")
                     .select(F.col("page_id").alias("refers_to"), F.col("stored_digest").alias("payload_digest")).distinct(),
                     ["refers_to", "payload_digest"], "left_semi")
               .withColumn("_found", F.lit(True)))
    own = (F.col("stored_digest") == F.col("payload_digest")) & (F.col("stored_bytes") == F.col("payload_bytes"))
    return (rows.join(targets, ["refers_to", "payload_digest"], "left")
            .withColumn("resolves", F.when(F.col("record_type") == "revisit", F.coalesce("_found", F.lit(False)))
                        .otherwise(own))
            .drop("_found", "stored_bytes"))


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archives to a fresh shared folder, read them back and resolve the revisits."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder, least=least)
    return resolved(read(pages.sparkSession, folder))
