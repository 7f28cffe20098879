"""WARC archives with revisit resolution (operator 10).

Only headers are shuffled to find equal payloads: a partial minimum of the page id by payload
digest, joined back to the headers. The revisits found are broadcast up to ``SENT`` of them, and
beyond that joined by shuffle. Each task then packs its pages into archives of about
``archive_bytes``: a warcinfo record, response records with the payload, and revisit records with a
fresh header that refers to the response, every record a gzip member of its own, so that a reader can
start at any of them. Spark's own writer commits the archives, one row each, so a lost executor only
repeats its tasks; a zero byte, which gzip passes over, ends each file. Reading goes by
Content-Length, an archive at a time; a revisit takes its payload's length from the response that
it refers to.

Defined results: a null html is an empty payload; payloads under ``least`` bytes are always
responses; among equal payloads the smallest page_id is the response, and rows that repeat that
page_id with that payload are responses too, under the same record id; a null page_id is larger than
any other, and refers to a response if another page has its payload, else rows of null ids are all
responses; page ids of any kind come back as they were; a null url leaves its header out; control
characters in a url are percent-encoded; an empty table gives an empty archive; columns other than
the three named may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import lean, pieces
from lexloom.llm.storage import drop, fresh_path, materialise

LEAST = 100
ARCHIVE_BYTES = 32_000_000
SENT = 200_000
#: Fixed values of the format: what a revisit's profile is called, and the line ends after a record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ABOUT = b"software: lexloom\r\nformat: WARC File Format 1.1\r\n"


def resolve(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """The revisits: id, digest and refers_to. Only ids, digests and lengths are shuffled."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    heads = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    firsts = heads.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").drop("copies")
    return heads.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to"))).select("id", "digest", "refers_to").distinct()


def record_id(page: str | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit knows what it refers to."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}\0{digest}'.encode()).digest()[:16], version=5)}>"


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return gzip.compress(b"".join((b"WARC/1.1\r\n", head.encode(), f"Content-Length: {len(block)}\r\n\r\n".encode(), block, END)), 5, mtime=0)


def _page(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    again = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": PROFILE if again else None,
        "WARC-Refers-To": record_id(refers_to, digest) if again else None,
        "Page-ID": None if page is None else quote(page, safe=""),
        "Content-Type": "application/http;msgtype=response",
    }
    return record(fields, HTTP if again else HTTP + payload)


def _archives(rows: DataFrame, archive_bytes: int, date: str) -> DataFrame:
    """Archives, one a row. rows: id and refers_to as text, url, html, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in pieces(batches, "html"):
            for page, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "digest", "refers_to")), strict=True):
                if not held:
                    held.append(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, ABOUT))
                held.append(_page(page, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    return rows.mapInArrow(lean(run), "archive binary")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, sent: int = SENT) -> None:
    """Deduplicated archives below ``path``, named *.warc.gz."""
    spark = pages.sparkSession
    again, again_at = materialise(resolve(pages, id_col, html_col, least), "revisits")
    again = again.withColumnsRenamed({"id": "own", "digest": "same"})
    small = again.count() <= sent  # then the payloads need not be shuffled to meet their headers
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    rows = rows.join(F.broadcast(again) if small else again, F.col("id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("same")), "left")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    archives = _archives(rows.select(F.col("id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string")), archive_bytes, date)
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    drop(spark, again_at)
    jvm = spark.sparkContext._jvm
    fs = (folder := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):  # the writer has no say in the names' ends
        if (name := status.getPath().getName()).endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{name.removesuffix('.txt')}.warc.gz"))


RECORD = T.StructType([
    T.StructField("record_type", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("declared_digest", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a WARC record is cut short")
        yield head, block


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The archives' responses and revisits, one row each, as ``RECORD`` says. A revisit's payload
    length and digest are null here; ``resolved`` fills them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for head, block in records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(memoryview(content.as_buffer()))))):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    revisit = head["warc-type"] == "revisit"
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    page = head.get("page-id")
                    rows.append((head["warc-type"], head["warc-record-id"], None if page is None else unquote(page), head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to"), None if revisit else len(payload), None if revisit else hashlib.sha256(payload).hexdigest(), payload if with_payload and not revisit else None))
                    size += len(payload) if with_payload else 0
                    if len(rows) >= 2000 or size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").mapInArrow(lean(run), RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORD.names)


def resolved(found: DataFrame) -> DataFrame:
    """Revisits joined to the responses that they refer to, with that page as refers_to; a digest
    that differs from what the record declares is an error. found is read more than once."""
    own = found.select("record_type", "record_id", "page", "url", "declared_digest", "refers_to", "payload_bytes", "payload_digest")
    again = own.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    # only the responses that revisits refer to; each once, however often it was archived
    origin = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(*(F.min(c).alias(c) for c in ("payload_bytes", "payload_digest")), F.min("page").alias("first"))
    filled = again.join(origin, "refers_to", "left").select("record_type", "record_id", "page", "url", "declared_digest", F.col("first").alias("refers_to"), "payload_bytes", "payload_digest")
    out = own.where("record_type = 'response'").unionByName(filled)
    sound = F.col("declared_digest").eqNullSafe(F.concat(F.lit("sha256:"), "payload_digest"))
    return out.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs in "), "record_id"))))


def archive_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """Pages written as archives in the shared folder, read back: id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col, **how)
    found, _ = materialise(read(spark, path).drop("payload"), "records")
    kind = pages.schema[id_col].dataType
    return resolved(found).select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p
), f AS (
  SELECT digest, min(page_id) AS first_id FROM h WHERE n >= 100 GROUP BY digest
)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, h.digest AS payload_digest,
       CASE WHEN f.first_id <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> h.page_id THEN f.first_id END AS refers_to
FROM h LEFT JOIN f ON h.digest = f.digest AND h.n >= 100
"""
