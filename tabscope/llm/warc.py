"""WARC archives in which repeated payloads are stored once.

``resolve_revisits`` shuffles headers only: of the rows whose payload has at least ``min_bytes`` bytes and the same
SHA-256, the one with the least key is the original (``response``), the others become ``revisit``.  The least key
of a digest comes from a group-by with map-side combining, so a payload that a third of all rows share costs no
more than any other.  ``write_archives`` joins these decisions to the pages and writes records with fresh
headers; payloads never go through the shuffle while the table of decisions is small enough to be broadcast
(counted first), and are shuffled by key once beyond that.  ``read_archives`` parses the written files by
Content-Length and resolves each revisit by a join on the record id that it refers to.

Files.  A record is its headers, an empty line, its block, and two line ends.  Spark's text writer with that
record end as line separator writes exactly this, through the committer, so lost executors leave no partial
archive and any file system that Spark writes to will do.  ``target_bytes`` sets how many records of average
size a file takes; files are read whole, one at a time.

Defined cases: null html is an empty payload; null url leaves the target out; line ends, blanks and control
characters in a url are percent-encoded; rows with null page_id come after all others and are written without a
record name (a revisit of such a response refers to null); of equal rows with a shared payload one is the
response; smaller payloads are always responses; an empty table writes an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.common import scratch_path, scratch_table, small_side

MIN_BYTES = 100
RECORD_END = "\r\n\r\n"
WRITTEN = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PAGE_URN = "urn:page:"
COLUMNS = ("record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_id string, "
           "target string, declared string")


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages: (page_id, url, html).  One row for each distinct (page_id, url, digest): copies (rows that are
    equal in these), payload_bytes, original_id, original_url; ``original`` says that it holds the response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    headers = scratch_table(
        pages.select("page_id", "url", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("digest"))
        .groupBy("page_id", "url", "digest", "payload_bytes").agg(F.count("*").alias("copies")), "warc-headers")
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    shared = (headers.where(F.col("payload_bytes") >= min_bytes).groupBy("digest")
              .agg(F.min(order).alias("first"), F.sum("copies").alias("rows")).where("rows > 1"))
    shared = scratch_table(shared.select("digest", F.col("first.page_id").alias("original_id"), F.col("first.url").alias("original_url")), "warc-originals")
    mark = F.col("page_id").eqNullSafe(F.col("original_id")) & F.col("url").eqNullSafe(F.col("original_url"))
    return scratch_table(headers.join(shared, "digest").withColumn("original", mark), "warc-revisits")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{PAGE_URN}"), page_id.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _target(url: Column) -> Column:
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code else url
    return url


def _record(kind: str, page_id: Column, url: Column, digest: Column, refers: Column | None, payload: Column | None) -> Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {WRITTEN}\r\n"), _line("WARC-Record-ID", _urn(page_id)),
            _line("WARC-Target-URI", _target(url)), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest))]
    if payload is None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        block = F.lit(HTTP + "\r\n")
        head += [F.lit(f"WARC-Profile: {profile}\r\n"), _line("WARC-Refers-To", _urn(refers))]
    else:
        block = F.concat(F.lit(HTTP), _line("Content-Length", F.octet_length(payload).cast("string")), F.lit("\r\n"), payload)
    head += [F.lit("Content-Type: application/http;msgtype=response\r\n"), _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n")]
    return F.concat(*head, block).alias("value")


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, target_bytes: int = 32 << 20) -> None:
    """Write one record for each row of pages (page_id, url, html) below ``path``."""
    pages = pages.select("page_id", "url", "html")
    shared = resolve_revisits(pages, min_bytes)
    html = F.coalesce("html", F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    as_response = _record("response", F.col("page_id"), F.col("url"), F.col("digest"), None, F.col("html"))
    as_revisit = _record("revisit", F.col("page_id"), F.col("url"), F.col("digest"), F.col("original_id"), None)

    marks = shared.select(F.col("page_id").alias("m_id"), F.xxhash64("url").alias("m_url"), F.xxhash64("digest").alias("m_digest"),
                          "original_id", "original", "copies")
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("digest"))
    key = rows["page_id"].eqNullSafe(F.col("m_id")) & (F.xxhash64(rows["url"]) == F.col("m_url")) & (F.xxhash64(rows["digest"]) == F.col("m_digest"))
    marked = rows.join(small_side(scratch_table(marks, "warc-marks")), key, "left")
    # A response of which equal rows exist is written from the grouped rows below, once, and its copies as revisits.
    once = marked.where("original is null or not original or copies = 1")
    records = once.select(F.when(F.col("original") == F.lit(False), as_revisit).otherwise(as_response).alias("value"))
    equal = shared.where("original and copies > 1")
    if not equal.isEmpty():
        first = (marked.where("original and copies > 1").groupBy("page_id", "url", "digest").agg(F.first("html").alias("html")))
        records = records.unionByName(first.select(as_response)).unionByName(
            equal.withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies")))).select(as_revisit))
    size = pages.agg(F.avg(F.octet_length(html)).alias("mean")).first().mean or 0
    (records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", max(1, int(target_bytes / (size + 500))))
     .text(path))


def parse_records(data: bytes):
    """Yields (headers with lower-case names, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        length = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + length]
        at = end + 4 + length + len(RECORD_END)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``: record_id, record_type, payload_bytes and payload_digest of
    the payload as read (null for revisits), refers_id, target, declared (the digest in the header)."""

    def parse(batches):
        for batch in batches:
            rows = []
            for content in batch.column(0):
                for h, block in parse_records(content.as_py()):
                    payload = None
                    if h["warc-type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                    rows.append((h.get("warc-record-id"), h["warc-type"], None if payload is None else len(payload),
                                 None if payload is None else hashlib.sha256(payload).hexdigest(), h.get("warc-refers-to"),
                                 h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha256:")))
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in COLUMNS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content").mapInArrow(parse, COLUMNS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back and resolves revisits: page_id (string), payload_bytes, payload_digest, record_type,
    refers_to (string), declared."""
    records = scratch_table(read_records(spark, path), "warc-records")
    page = lambda urn: F.regexp_extract(urn, f"^<{PAGE_URN}(.*)>$", 1)
    full = records.where("record_type = 'response'")
    wanted = records.where("record_type = 'revisit'").select(F.col("declared").alias("wanted")).distinct()
    originals = scratch_table(full.join(wanted, full["payload_digest"] == wanted["wanted"], "left_semi")
                              .groupBy(F.col("record_id").alias("o_id"), F.col("payload_digest").alias("o_digest"))
                              .agg(F.first("payload_bytes").alias("o_bytes")), "warc-resolved")
    again = records.where("record_type = 'revisit'").join(
        originals, F.col("refers_id").eqNullSafe(F.col("o_id")) & (F.col("declared") == F.col("o_digest")), "left")
    out = [page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_id").alias("refers_to"), "declared"]
    return full.select(*out).unionByName(
        again.withColumns({"payload_bytes": F.col("o_bytes"), "payload_digest": F.col("o_digest")}).select(*out))


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write pages into archives below the checkpoint folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
