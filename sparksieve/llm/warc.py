"""WARC archives: writing, reading, and deduplication by revisit records (operator 3).

``write_archive`` builds the records with SQL functions and writes them as gzip
text files, CRLF being the line separator, so any store that Spark writes will
do.  ``read_archive`` takes the files as binary rows and walks their records by
Content-Length in Arrow batches.  ``resolve`` shuffles headers only, by payload
digest, with one row a digest and task after the partial aggregation;
``rewrite`` joins the originals of repeated payloads to the records (broadcast
only while a count shows them to be few) and writes archives with fresh
headers, in which a repeated payload is stored once.

Defined results: a null payload is an empty one; of records with equal payloads
the one with the smallest page id is the response, and rows that share that
id are all responses; a null id counts as the largest, and where all ids are
null all are responses; a null URI becomes ``urn:page:<id>``, and white space
and control characters in one are percent-encoded; a revisit record without an
original in the archives keeps its old reference; an empty table makes an empty
archive.

A file is held in memory as it is stored, so archives read here should have
files of bounded size; the writer starts a new file after ``max_records`` or what
``max_bytes`` are by the mean payload.  A file is one gzip stream, since the text
sink writes it; columns that a record has no place for are not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import checked_broadcast, written
from .textkit import tidy

CRLF = "\r\n"
#: The profile that the WARC standard names for payloads equal by digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "uri", "date", "payload_digest", "refers_to_id", "refers_to_uri", "refers_to_date")]
    + [T.StructField(n, T.LongType()) for n in ("page_id", "payload_bytes", "refers_to")]
    + [T.StructField("payload", T.BinaryType())]
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: five hex digits make four base32 digits."""
    hex_ = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def captures(pages: DataFrame, page_id: str = "page_id", uri: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """RECORD rows, all responses, out of a table of pages."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    page = F.col(f"`{page_id}`").cast("long")
    clean = F.regexp_replace(F.coalesce(F.col(f"`{uri}`").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")))), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(page.alias("page_id"), clean.alias("uri"), body.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    return rows.select(
        _uuid(F.col("page_id"), F.col("uri"), F.col("payload_digest")).alias("record_id"), F.lit("response").alias("record_type"), "uri", F.lit(date).alias("date"), "payload_digest", *[F.lit(None).cast("string").alias(c) for c in ("refers_to_id", "refers_to_uri", "refers_to_date")], "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"), "payload",
    )


def _record_text(r: DataFrame) -> Column:
    """The record as it stands in an archive, without its last CRLF; bytes are kept as they are."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col("payload"), F.lit(b"")).cast("string"))
    block_bytes = F.octet_length(http) + F.octet_length(body)
    line = lambda name, value: F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.col("refers_to_id")), line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), line("WARC-Refers-To-Date", F.col("refers_to_date")), line("X-Refers-To-Page", F.col("refers_to")),
        line("X-Page-Id", F.col("page_id")), line("X-Payload-Bytes", F.col("payload_bytes")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"), line("Content-Length", block_bytes), F.lit(CRLF), http, body, F.lit(CRLF),
    )


def write_archive(records: DataFrame, path: str, max_records: int = 20_000, max_bytes: int = 256 << 20, mean_bytes: float | None = None) -> None:
    """Write RECORD rows as gzip WARC files into a new folder, of at most ``max_records``, and of about ``max_bytes`` of payloads by their mean."""
    if mean_bytes is None:
        mean_bytes = records.agg(F.avg(F.coalesce(F.length("payload"), F.lit(0)))).first()[0] or 0.0
    rows = max(1, min(max_records, int(max_bytes / (mean_bytes + 1000))))
    text = records.select(_record_text(records).alias("value"))
    text.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of every record of a file, gzip or plain."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {headers.get('warc-record-id')} ends after {len(block)} of {size} bytes")
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> dict:
    http = headers.get("content-type", "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    kind = headers.get("warc-type", "")
    whole = kind != "revisit"
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "record_id": headers.get("warc-record-id"), "record_type": kind, "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else headers.get("warc-payload-digest", "").removeprefix("sha1:"),
        "refers_to_id": headers.get("warc-refers-to"), "refers_to_uri": headers.get("warc-refers-to-target-uri"), "refers_to_date": headers.get("warc-refers-to-date"), "page_id": number("x-page-id"), "payload_bytes": len(payload) if whole else number("x-payload-bytes"), "refers_to": number("x-refers-to-page"), "payload": payload if whole else None,
    }


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the archives in a folder; digests and lengths are taken from the payloads themselves."""
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    names = schema.names
    arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema.fields])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse(content.as_py()):
                    row = _row(headers, block)
                    rows.append({k: row[k] for k in names})
                    size += len(block) * payloads + 500
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def resolve(headers: DataFrame) -> tuple[DataFrame, float]:
    """The written table of originals (digest, first page, its record) of payloads that several records have; all payloads' mean bytes."""
    whole = F.col("record_type") != "revisit"
    of = F.when(whole, F.struct("page_id", "record_id", "uri", "date"))
    grouped = headers.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"), F.min(F.when(F.col("page_id").isNotNull(), of)).alias("o"))
    # what a lone payload adds to the mean is all that is kept of it
    several = F.col("n") > 1
    table = written(grouped.select("n", "bytes", F.when(several, F.col("payload_digest")).alias("o_digest"), F.when(several, F.col("o")).alias("o")), "originals")
    mean = table.agg(F.sum("bytes") / F.sum("n")).first()[0] or 0.0
    return table.where("o is not null").select("o_digest", F.col("o.page_id").alias("o_page"), F.col("o.record_id").alias("o_record"), F.col("o.uri").alias("o_uri"), F.col("o.date").alias("o_date")), mean


def rewrite(records: DataFrame, originals: DataFrame, path: str, min_bytes: int = 0, mean_bytes: float | None = None) -> None:
    """Write the deduplicated archive: later records of a payload of min_bytes or more become revisits."""
    # a row has a URI and ids, some 200 bytes
    joined = records.join(checked_broadcast(originals, 100_000), F.col("payload_digest") == F.col("o_digest"), "left")
    later = F.col("o_page").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("o_page"))) & (F.col("payload_bytes") >= min_bytes)
    turned = F.coalesce(later, F.lit(False)) | ((F.col("record_type") == "revisit") & F.col("o_page").isNotNull())
    fresh = {
        "record_type": F.when(turned, F.lit("revisit")).otherwise(F.col("record_type")),
        "record_id": _uuid(F.lit("deduplicated"), F.col("record_id")),
        "refers_to": F.when(turned, F.col("o_page")).otherwise(F.col("refers_to")),
        "refers_to_id": F.when(turned, _uuid(F.lit("deduplicated"), F.col("o_record"))).otherwise(F.col("refers_to_id")),
        "refers_to_uri": F.when(turned, F.col("o_uri")).otherwise(F.col("refers_to_uri")),
        "refers_to_date": F.when(turned, F.col("o_date")).otherwise(F.col("refers_to_date")),
    }
    write_archive(joined.select(*[fresh.get(n, F.col(n)).alias(n) for n in RECORD.names]), path, mean_bytes=mean_bytes)


def deduplicate_archive(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> DataFrame:
    """Deduplicate the archives in ``source`` into ``target``; returns the headers of what was written."""
    originals, mean = resolve(read_archive(spark, source, payloads=False))
    rewrite(read_archive(spark, source), originals, target, min_bytes, mean)
    return read_archive(spark, target, payloads=False)
