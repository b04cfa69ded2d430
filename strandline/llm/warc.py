"""Deduplicated WARC archives: records of equal payload become revisits of one response.

Headers (id, digest, size) are shuffled by payload digest and the id of the response joined to each; pages meet what was
found by their own ids, which no two payloads share, so a payload that many pages have doesn't gather in one task. Then
every record is written with fresh headers. Spark's text writer makes the archives: one value is one record, records are
divided by the two line ends that WARC asks for, and each file is compressed as a whole (the writer has no other way, so a
reader can't seek to a record inside). They are read back by content length, and payloads are hashed again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import forget, new_folder, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes in one archive file, about.
FILE_BYTES = 16_000_000
_LINE = "\r\n"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: four letters for every five digits."""
    letters = []
    for k in range(8):
        number = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def headers(pages: DataFrame) -> DataFrame:
    """Rows (page_id, digest, size) of ``pages`` (page_id, url, payload)."""
    return pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))


def originals(heads: DataFrame) -> DataFrame:
    """Rows (digest, size, first) for each payload that several headers share: first is the largest id."""
    shared = heads.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return shared.filter("n > 1").drop("n")


def revisits(heads: DataFrame) -> DataFrame:
    """Rows (page_id, digest, size, first) of the headers that another response stands for: first is its id."""
    firsts = originals(heads).select(F.col("digest").alias("digest2"), F.col("size").alias("size2"), "first")
    met = heads.distinct().join(firsts, (F.col("digest") == F.col("digest2")) & (F.col("size") == F.col("size2")))
    return met.filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "size", "first")


def records(pages: DataFrame, found: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, payload) as WARC records: a column ``record`` of text. found: of ``revisits``."""
    found = found.select(F.col("page_id").alias("page_id2"), F.col("digest").alias("digest2"), F.col("size").alias("size2"), "first")
    own = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    same = F.col("page_id").eqNullSafe(F.col("page_id2")) & (F.col("digest") == F.col("digest2")) & (F.col("size") == F.col("size2"))
    found = own.join(found, same, "left")
    again = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=UTF-8{_LINE}Content-Length: "), F.col("size"), F.lit(_LINE * 2))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")))),
        F.when(again, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return found.select(F.concat(F.concat_ws(_LINE, *lines), F.lit(_LINE * 2), block).alias("record"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write each of ``pages`` as a response, or as a revisit of the equal payload with the largest id.

    A null payload is empty; a null url leaves its header out; a repeated row of the response's id is a response too;
    null ids are smallest. Other columns don't matter. An empty table gives archives without records.
    """
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload"))
    heads = stored(headers(named), "headers")
    total, n = heads.agg(F.sum("size"), F.count(F.lit(1))).first()
    each = max(1, file_bytes * n // max(1, total or 0)) if n else 1
    found = stored(revisits(heads.filter(F.col("size") >= least_bytes)), "revisits")
    records(named, found, date).write.option("lineSep", _LINE * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)
    forget(heads, found)


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The header fields (names in lower case) and the block of each record in an archive's bytes."""
    at, whole = 0, memoryview(raw)
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        if head < 0:
            break
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(raw[at:head])}
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = head + 4 + int(fields["content-length"])
        yield fields, whole[head + 4 : end]
        at = end + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_py()
            if raw[:2] == b"\x1f\x8b":
                raw = gzip.decompress(raw)
            rows: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")}
            for fields, block in parse_records(raw):
                body = bytes(block)
                head = body.find(b"\r\n\r\n")
                http = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(body[:head])}
                refers = fields.get("warc-refers-to")
                rows["page_id"].append(_page(fields["warc-record-id"]))
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                if fields["warc-type"] == "response" and (len(body) - head - 4, base64.b32encode(hashlib.sha1(body[head + 4 :]).digest()).decode()) != (size, digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} is not what its headers say")
                rows["payload_bytes"].append(size)
                rows["payload_digest"].append(digest)
                rows["record_type"].append(fields["warc-type"])
                rows["refers_to"].append(_page(refers) if refers else None)
                rows["url"].append(fields.get("warc-target-uri"))
                rows["payload"].append(body[head + 4 :] if fields["warc-type"] == "response" else None)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))


def _page(record_id: str) -> int | None:
    own = record_id.removeprefix("<urn:x-page:").removesuffix(">")
    return None if own == "none" else int(own)


def read_archives(spark, path: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def resolve_revisits(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives (in the shared folder if no path is given) and read them back."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    write_archives(pages, path, least_bytes=least_bytes)
    return read_archives(spark, path)
