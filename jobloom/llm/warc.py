"""WARC: writing captures as archives, reading archives back, and assembling request, response and metadata into one row.

Writing is a Spark text write: a record's bytes end with the two line breaks that the format puts between records, which
is the writer's line separator, so Spark's commit protocol and any shared file system apply.  Archives are read as whole
files of bounded size and parsed by Content-Length, so payloads may hold anything, record headers included.  Pages are
written by classes of size, so an archive holds some 128 MB at most, and only what is larger has an archive of its own.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, new_path, stored

DATE = "2024-01-01T00:00:00Z"
#: Payloads of up to so many bytes share an archive with so many captures.
CLASSES = [(1 << 18, 500), (1 << 22, 32), (1 << 25, 4), (1 << 62, 1)]
#: Payloads of at least so many bytes are written once; later equal ones are revisits.
LEAST_BYTES = 0
PIECE = 1 << 20
RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, page_id bigint, date string, payload_bytes bigint, payload_digest string, intact boolean, block binary"


def base32_sha1(x: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in base 32: of each 5 hex digits 4 digits of base 32."""
    pieces = [F.lpad(F.conv(F.substring(F.sha1(x), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*pieces), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column | str) -> Column:
    """A header line; none for a null value.  Line breaks in a value would end it, so they are percent-coded."""
    value = F.regexp_replace(F.regexp_replace(F.lit(value) if isinstance(value, str) else value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: Column | str, record_id: Column, fields: list[Column], content_type: str, block: Column) -> Column:
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit("WARC/1.1\r\n"), _field("WARC-Type", kind), _field("WARC-Record-ID", record_id), _field("WARC-Date", DATE), *fields, _field("Content-Type", content_type), _field("Content-Length", size), F.lit("\r\n"), block)


def _own(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, url, html, mark, key): ``mark`` tells apart rows that share a page_id, ``key`` stands for the payload (SHA-256)."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html")).withColumn("key", F.sha2("html", 256))
    return own.withColumn("mark", F.substring(F.sha1(F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), "key")), 1, 16))


def firsts(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, size, first): of each payload of at least ``least_bytes`` the row with the smallest page_id, stored.  Pre-aggregated before its shuffle."""
    own = _own(pages).withColumn("size", F.octet_length("html")).where(F.col("size") >= least_bytes)
    return stored(own.groupBy("key").agg(F.min("size").alias("size"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "mark")).alias("first")), "firsts")


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write three records for each page to gzip archives in folders of ``path``: request, response or revisit, metadata."""
    first = firsts(pages, least_bytes)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    of_class = lambda n: sum((F.when(n > top, 1).otherwise(0) for top, _ in CLASSES[:-1]), F.lit(0))
    there = {r.k for r in first.select(of_class(F.col("size")).alias("k")).distinct().collect()} if least_bytes <= CLASSES[0][0] else set(range(len(CLASSES)))
    for k, (_, captures_a_file) in enumerate(CLASSES):
        if k == 0 or k in there:  # a payload below ``least_bytes`` is of the first class
            _write(pages.where(of_class(size) == k), first, f"{path}/class-{k}", captures_a_file)
    drop_stored(first)


def _write(pages: DataFrame, first: DataFrame, path: str, captures_a_file: int) -> None:
    # both sides of this join are plain shuffles, which AQE splits where very many payloads are equal
    roles = _own(pages).join(first, "key", "left").select("page_id", "url", "html", "mark", F.coalesce("first.page_id", "page_id").alias("first_id"), F.coalesce("first.mark", "mark").alias("first_mark"))

    def name(page, mark, kind):
        return F.concat(F.lit("<urn:jobloom:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), mark, F.lit(f":{kind}>"))

    c = F.col
    revisit = ~(c("page_id").eqNullSafe(c("first_id")) & (c("mark") == c("first_mark")))
    answer, origin = name(c("page_id"), c("mark"), "response"), name(c("first_id"), c("first_mark"), "response")
    about = [_field("WARC-Target-URI", c("url")), _field("X-Page-Id", c("page_id").cast("string"))]
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    whole = [_field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(c("html")))), _field("X-Payload-Length", size)]
    again = [_field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _field("WARC-Refers-To", F.when(revisit, origin))]
    response = _record(F.when(revisit, "revisit").otherwise("response"), answer, about + whole + again, "application/http; msgtype=response", F.concat(http, F.when(revisit, "").otherwise(c("html"))))
    request = _record("request", name(c("page_id"), c("mark"), "request"), [_field("WARC-Concurrent-To", answer), *about], "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", "[\r\n]", ""), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", name(c("page_id"), c("mark"), "metadata"), [_field("WARC-Concurrent-To", answer), *about], "application/warc-fields", F.concat(F.lit("payload-characters: "), F.length("html").cast("string"), F.lit("\r\n")))
    records = roles.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_a_file).text(path)


def _plain(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, unpacked piece by piece if it is gzip (of one or many members)."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            piece = unpack.decompress(data, PIECE)
            if not piece and not unpack.unconsumed_tail and not unpack.eof:
                raise ValueError("the archive ends within a gzip member")
            yield piece
            data = unpack.unconsumed_tail if not unpack.eof else unpack.unused_data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased named fields, block) of each record of an archive."""
    pieces, held, at = _plain(data), bytearray(), 0  # what lies before ``at`` has been read

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while held[at : at + 1] in (b"\r", b"\n", b""):  # between records
            if at < len(held):
                at += 1
            elif not more():
                return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise ValueError("the archive ends within a record's header")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, size = end + 4, int(fields["content-length"])
        while len(held) - at < size:
            if not more():
                raise ValueError("the archive holds no whole record where one should start")
        if not lines[0].startswith("WARC/"):
            raise ValueError("the archive holds no whole record where one should start")
        block = bytes(memoryview(held)[at : at + size])
        at += size
        yield fields, block


def read(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """The records of all archives in ``path``, one row each; ``blocks``: with the block's bytes.

    Length and digest are those of the payload that is read; a revisit has those of its header.  ``intact``: what was
    read agrees with the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [{"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse(content.as_py()):
                    kind, page = f.get("warc-type"), f.get("x-page-id")
                    payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    said = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    intact = not said or kind == "revisit" or said == digest
                    if kind == "revisit":
                        size, digest = int(f.get("x-payload-length", 0)), said
                    rows.append((kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), int(page) if page else None, f.get("warc-date"), size, digest, intact, block if blocks else None))
                    held += len(block) if blocks else 300
                    if held > 4 * PIECE:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, request, response, metadata).

    The records of a transaction are joined by the identifier that their concurrent-to field names, a response's own
    identifier.  A response without request or metadata has null there; of repeated ones the least stays; a request or
    metadata record of no response makes no row; no records give no rows.
    """
    every = F.struct(*(F.col(c) for c in records.columns))
    response = records.where("record_type in ('response', 'revisit')").select("record_id", every.alias("response"))

    def part(kind):
        return records.where(F.col("record_type") == kind).where("concurrent_to is not null").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(every).alias(kind))

    return response.join(part("request"), "record_id", "left").join(part("metadata"), "record_id", "left").select("record_id", "request", "response", "metadata")


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, request, response, metadata): every page written to archives in the shared folder and read back, a nested row per capture.

    A null html is an empty payload; a very long one is an archive of its own.  Rows that share a page_id give a row each;
    rows that agree in page_id, url and payload have one record name and are all what the first of them is; a row
    without a page_id is a response only if no row of its payload has one.
    an empty table gives no rows; other columns are ignored.  The records are kept as a table, so archives are parsed once.
    """
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    records = stored(read(pages.sparkSession, path), "records")
    r = F.col("response")
    origin = F.regexp_extract(r["refers_to"], "^<urn:jobloom:(-?[0-9]+):", 1)
    return captures(records.drop("block")).select(r["page_id"].alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["record_type"].alias("record_type"), F.when(origin != "", origin).cast("bigint").alias("refers_to"), "request", "response", "metadata")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, length(html) AS chars, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS request_uri, 22 + length(CAST(chars AS VARCHAR)) AS metadata_bytes
FROM d
"""
