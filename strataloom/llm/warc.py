"""WARC archives: writing captures, reading records back, and assembling transactions.

Archives are written by Spark's text writer: headers are ASCII and payloads UTF-8, so a record
is a string and the line separator is the second half of the blank line that ends a record.
Files are committed like any other table, on any store. Reading streams each archive through
decompression and cuts records by Content-Length, never by what a payload contains.

Assembly joins request, response (or revisit) and metadata records through
WARC-Concurrent-To: a record belongs to the capture of the record that it names, directly or
over one record between, and a response may also name the others. One nested row per capture.
Requests and metadata of a capture are gathered in its row; a record whose capture is missing
makes a row without a response.

Defined cases: a null html is an empty payload, a null url an absent header; a page whose
page_id, url and html repeat exactly is one capture; equal payloads under 100 bytes are all
responses; of equal payloads that with the smallest page_id is the response, and a null page_id
is never a revisit; payloads may have any length (files are bounded by bytes, and a record too
large for a file's bound has one of its own); an empty table makes no records; extra columns,
also those named like the operator's own, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Payload bytes up to which so many records go to a file, so that a file holds some 400 MB before compression at most, or one record.
RECORDS_PER_FILE = ((1 << 16, 6000), (1 << 22, 90), (1 << 62, 1))
#: Record types that stand for a capture. Fixed values.
CAPTURES = ("response", "revisit", "resource")
_DATE = "2026-01-01T00:00:00Z"


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the last line end; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, length), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, response_page: the page whose response a revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    full = C.only(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("bytes"))
    first = full.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").select("digest", "first")
    first = C.materialise(first, "digests")
    return full.join(C.checked_broadcast(first), "digest", "left").withColumn("response_page", F.when(F.col("page_id") > F.col("first"), F.col("first")))


def write_archives(pages: DataFrame, path: str) -> None:
    """Response or revisit, request and metadata records of every page, in gzip files under ``path``."""
    p = page_captures(pages)
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    own = _record_id("response", F.col("page_id"), F.col("url"), F.col("digest"))
    request, metadata = (_record_id(k, F.col("page_id"), F.col("url"), F.col("digest")) for k in ("request", "metadata"))
    again = F.col("response_page").isNotNull()
    common = [("WARC-Date", F.lit(_DATE)), ("WARC-Target-URI", url)]
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.when(again, "").otherwise(F.col("html")))
    get = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    records = F.array(
        _record(
            [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common, ("WARC-Page-ID", F.col("page_id")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
             ("WARC-Refers-To-Page", F.col("response_page")), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http; msgtype=response"))],
            answer,
        ),
        _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], get),
        _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", metadata), *common, ("WARC-Concurrent-To", request), ("Content-Type", F.lit("application/warc-fields"))], F.lit("fetchTimeMs: 0\r\n")),
    )
    largest, above = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0, -1
    for bound, n in RECORDS_PER_FILE:
        some = p.where((F.octet_length("html") > above) & (F.octet_length("html") <= bound)) if largest > RECORDS_PER_FILE[0][0] else p
        some.select(F.explode(records).alias("value")).write.mode("append").option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", n).text(path)
        if largest <= bound:
            break
        above = bound


# --- reading ------------------------------------------------------------------------------


def _plain(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, gzip members undone one after another."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), step):
            yield bytes(content[at : at + step])
        return
    at, undo, left = 0, zlib.decompressobj(31), b""
    while left or at < len(content):
        part = left or bytes(content[at : at + step])
        at, left = (at, b"") if left else (at + step, b"")
        yield undo.decompress(part)
        if undo.eof:
            left, undo = undo.unused_data, zlib.decompressobj(31)


def parse_records(content: memoryview) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of every record."""
    chunks, held = _plain(content), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(chunks, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 or not held.startswith(b"WARC/"):
            if held[:1] in (b"\r", b"\n"):
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
            elif end >= 0:
                raise ValueError("not at the head of a record")
            if (held.find(b"\r\n\r\n") < 0 or not held) and not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
        headers: dict[str, list[str]] = {}
        for line in bytes(held[:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.decode().strip().lower(), []).append(value.decode("utf-8", "replace").strip())
        size = int(headers["content-length"][0])
        if not fill(end + 4 + size):
            raise ValueError("an archive ends within a record")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield headers, block


_RECORD = "record_id string, type string, target_uri string, page_id string, concurrent_to array<string>, refers_to_page string, declared_digest string, payload_bytes bigint, payload_digest string"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives under ``path``. Length and digest are those of the payload read, after HTTP headers."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for content in batch["content"]:
                for h, block in parse_records(memoryview(content.as_buffer())):
                    one = lambda k: h.get(k, [None])[0]  # noqa: B023, E731
                    body = block.partition(b"\r\n\r\n")[2] if (one("content-type") or "").startswith("application/http") else block
                    row = (one("warc-record-id"), one("warc-type"), one("warc-target-uri"), one("warc-page-id"), h.get("warc-concurrent-to", []), one("warc-refers-to-page"), one("warc-payload-digest"), len(body), hashlib.sha256(body).hexdigest())
                    rows.append((*row, body) if with_payload else row)
                    held += (len(body) if with_payload else 0) + 500
                    if held > 1 << 22:
                        yield made(rows)
                        rows, held = [], 0
        yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds, labels = [*types, *[pa.binary()] * with_payload], [*names, *["payload"] * with_payload]
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=labels)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """capture_id, response (struct; a revisit's has its length and digest from the response it refers to), requests and metadata (arrays of structs)."""
    root = F.col("type").isin(*CAPTURES)
    named = records.where(~root).select("record_id", F.get("concurrent_to", F.lit(0)).alias("next")).where("next is not null")
    back = records.where(root).select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("next"))
    nexts = named.union(back).groupBy("record_id").agg(F.min("next").alias("next"))
    others = records.where(~root).join(nexts, "record_id", "left")
    others = others.join(nexts.toDF("next", "further"), "next", "left")
    columns = [c for c in records.columns]
    keyed = records.where(root).select(F.col("record_id").alias("capture_id"), *columns)
    keyed = keyed.union(others.select(F.coalesce("further", "next", "record_id").alias("capture_id"), *columns))
    row = F.struct(*columns)
    gathered = lambda kind: F.sort_array(F.collect_list(F.when(kind, F.struct("record_id", "target_uri", "payload_bytes", "payload_digest"))))
    return keyed.groupBy("capture_id").agg(
        F.max(F.when(root, row)).alias("response"), gathered(F.col("type") == "request").alias("requests"), gathered(~root & (F.col("type") != "request")).alias("metadata")
    )


def pages_of(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every captured page; a revisit's payload is looked up in the response it refers to."""
    r = captures.where("response is not null").select("response.*")
    own = r.select(F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_page").cast("bigint").alias("refers_to"), F.substring_index("declared_digest", ":", -1).alias("declared"))
    wanted = own.where("refers_to is not null").select("refers_to", "declared").distinct()
    full = own.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared"), F.col("payload_bytes").alias("full_bytes"))
    full = wanted.join(full, ["refers_to", "declared"]).distinct()
    out = own.join(full, ["refers_to", "declared"], "left")
    again = F.col("refers_to").isNotNull()
    return out.select("page_id", F.when(again, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(again, F.col("declared")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
