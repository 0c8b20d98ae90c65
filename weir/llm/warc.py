"""WARC archives: written from pages, read back, and assembled into captures.

Each page gives a request, a response (or a revisit of an equal payload) and a
metadata record; the latter two are concurrent to the request.  Archives are
written by Spark's text writer: a record is text that ends in the blank lines
between records, compressed as it is written.  Reading cuts files back into
records by their lengths, with digests taken from the payloads as read, and
joins the records of a capture through ``WARC-Concurrent-To``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weir.llm.common import hot_join, rows_of, written

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
#: Bytes of records, before compression, that a file should have. Revisits that a task may hold in memory; more are joined by a shuffle.
FILE_BYTES, BROADCAST_ROWS = 128 << 20, 1_000_000
#: Pages are written in classes of size, each up to so many times as large as the one before; the first goes up to LEAST_CLASS.
CLASS_FACTOR, LEAST_CLASS = 16, 64 << 10
#: Bytes that a record has beside its page, about.
RECORD_BYTES = 1500
CRLF = "\r\n"
CAPTURED = "2024-01-01T00:00:00Z"


def _id(page: Column, name: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), name, F.lit(f":{kind}>"))


def _record(kind: str, record: Column, request: Column, url: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """Headers, a blank line and the block; the blank lines that end a record come with the row's end."""
    concurrent = [] if kind == "request" else [F.lit("WARC-Concurrent-To: "), request, F.lit(CRLF)]
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record,
        F.lit(f"{CRLF}WARC-Date: {CAPTURED}{CRLF}WARC-Target-URI: "), url, F.lit(CRLF), *concurrent, *headers,
        F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block,
    )


def _size_class(n_bytes: Column) -> Column:
    above = F.greatest(F.lit(1.0), n_bytes / LEAST_CLASS)
    return F.ceil(F.log(above) / F.log(F.lit(float(CLASS_FACTOR)))).cast("int")


def write(pages: DataFrame, path: str) -> None:
    """Write three records for each row of ``pages`` (``page_id``, ``url``, ``html``) under ``path``.

    A null html is empty, a null url too.  Of pages with one payload of
    LEAST_BYTES or more, the one with the largest id keeps it and the others
    refer to it; rows that repeat this id all keep it.  Rows without a page_id
    keep their payloads.  A request is named by its row alone, a response by
    its page and payload, so revisits can refer to it.

    Files are cut by bytes: pages of a class of size are written by
    themselves, a file having as many as make FILE_BYTES on average.  The
    payloads are not shuffled unless over BROADCAST_ROWS pages are revisits.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "UTF-8"))
    n_bytes = F.octet_length("html")
    # of each row what is asked of its payload before it is written, in one scan
    every = rows.select("page_id", n_bytes.alias("bytes"), F.when(F.col("page_id").isNotNull() & (n_bytes >= LEAST_BYTES), digest).alias("same"))
    every = written(every, "heads")
    heads = every.filter("same is not null").select("page_id", "same")
    shared = heads.groupBy("same").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n"))
    revisits = hot_join(heads, shared.filter("low < top").drop("low"), "same", rows_of(heads))
    revisits = written(revisits.filter("page_id < top").select(F.col("page_id").alias("again"), "top", "same").distinct(), "revisits")
    if rows_of(revisits) <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    sizes = every.groupBy(_size_class(F.col("bytes")).alias("size")).agg(F.avg("bytes").alias("mean")).collect()
    # a row that is written has one uuid, whatever is read of it; that of a task run again is another, in another file
    rows = rows.withColumn("digest", digest).withColumn("row", F.expr("uuid()"))
    rows = rows.join(revisits, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("same")), "left")
    page, top = F.col("page_id"), F.col("top")
    url = F.regexp_replace("url", r"[\r\n]", " ")
    request = _id(page, F.col("row"), "request")
    own = _id(page, F.when(page.isNull(), F.col("row")).otherwise(F.col("digest")), "response")
    http = lambda n: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF + CRLF))
    ask = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    response = _record("response", own, request, url, [], "application/http;msgtype=response", F.concat(http(F.octet_length("html")), F.col("html")))
    refers = [F.lit("WARC-Refers-To: "), _id(top, F.col("digest"), "response"), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF)]
    revisit = _record("revisit", _id(page, F.col("row"), "revisit"), request, url, refers, "application/http;msgtype=response", http(F.lit(0)))
    records = F.array(
        _record("request", request, request, url, [], "application/http;msgtype=request", ask),
        F.when(top.isNull(), response).otherwise(revisit),
        _record("metadata", _id(page, F.col("row"), "metadata"), request, url, [], "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(CRLF))),
    )
    for r in sizes or [None]:
        some = rows.filter(_size_class(n_bytes) == r.size) if len(sizes) > 1 else rows
        each = max(1, int(FILE_BYTES // (r.mean + RECORD_BYTES))) if r else 1
        out = some.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
        out.option("maxRecordsPerFile", 3 * each).text(f"{path}/size={r.size if r else 0}")


class _Bytes:
    """Bytes of a file, decompressed as they are asked for; what was read is dropped now and then, not at each step."""

    def __init__(self, content: bytes) -> None:
        self.packed, self.at, self.place = content, 0, 0
        zipped = content[:2] == b"\x1f\x8b"
        self.left, self.inflate = (bytearray(), zlib.decompressobj(31)) if zipped else (content, None)

    def _more(self) -> bool:
        if self.inflate is None or self.at >= len(self.packed) and not self.inflate.unconsumed_tail:
            return False
        tail = self.inflate.unconsumed_tail
        if not tail:
            tail = self.packed[self.at : self.at + 262_144]
            self.at += len(tail)
        if self.place > 1 << 20:
            del self.left[: self.place]
            self.place = 0
        self.left += self.inflate.decompress(tail, 1 << 20)
        if self.inflate.eof:  # the next member of the file
            self.at -= len(self.inflate.unused_data)
            self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        looked = 0  # bytes from the place on in which the mark does not begin
        while (end := self.left.find(mark, self.place + looked)) < 0:
            looked = max(0, len(self.left) - self.place - len(mark) + 1)
            if not self._more():
                return None
        head, self.place = bytes(self.left[self.place : end]), end + len(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if self.place >= len(self.left) and not self._more():
                raise ValueError(f"a record ends {n} bytes early")
            part = bytes(self.left[self.place : min(len(self.left), self.place + min(n, 1 << 20))])
            self.place += len(part)
            n -= len(part)
            if part:
                yield part


def parse(content: bytes, with_payload: bool) -> Iterator[dict]:
    """The records of one file, each with its headers, payload length and digest."""
    data = _Bytes(content)
    while (head := data.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n, block, digest, size = int(fields["content-length"]), b"", hashlib.sha1(), 0
        kept: list[bytes] = []
        http = "http" in fields.get("content-type", "")
        for part in data.take(n):
            if http:  # the payload starts after the HTTP headers
                block += part
                if b"\r\n\r\n" not in block:
                    continue
                part, http, block = block.partition(b"\r\n\r\n")[2], False, b""
            digest.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if data.until(b"\r\n\r\n") is None:
            raise ValueError("a record is not closed")
        yield {
            "kind": fields.get("warc-type"), "record": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"), "concurrent_to": fields.get("warc-concurrent-to"), "refers_to": fields.get("warc-refers-to"),
            "stated_digest": fields.get("warc-payload-digest"), "size": size, "digest": digest.hexdigest(), "payload": b"".join(kept) if with_payload else None,
        }


RECORD = "kind string, record string, uri string, date string, concurrent_to string, refers_to string, stated_digest string, size long, digest string, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives (plain or gzip) under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for r in parse(content.as_py(), with_payload):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """One nested row for each capture: its request, response or revisit, and metadata.

    Records are joined through concurrent-to to their request.  A capture
    without a response has a null one, and the same for metadata.  A revisit
    takes length, digest and, if asked for, payload from the response that it
    refers to; of several responses of one name, which are of one page and
    payload, any serves.
    """
    body = F.struct("kind", "record", "uri", "date", "concurrent_to", "refers_to", "stated_digest", "size", "digest")
    part = lambda kinds, name, *more: records.filter(F.col("kind").isin(kinds)).select(F.col("concurrent_to").alias(f"{name}_of"), body.alias(name), *more)
    requests = records.filter("kind = 'request'").select(F.col("record").alias("capture"), body.alias("request"))
    responses, metadata = part(["response", "revisit"], "response", *(["payload"] if with_payload else [])), part(["metadata"], "metadata")
    whole = requests.join(responses, F.col("capture") == F.col("response_of"), "left").join(metadata, F.col("capture") == F.col("metadata_of"), "left")
    whole = whole.withColumn("target", F.col("response.refers_to")).drop("response_of", "metadata_of")
    asked = records.filter("refers_to is not null").groupBy(F.col("refers_to").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    full = records.filter("kind = 'response'").select(F.col("record").alias("target"), F.struct("size", "digest").alias("full"), *(["payload"] if with_payload else []))
    digests = full.join(asked, "target").groupBy("target").agg(F.any_value("full").alias("full"), F.any_value("n").alias("n"))
    found = hot_join(whole.filter("target is not null"), digests, "target", rows_of(records), "left").drop("n")
    whole = whole.filter("target is null").withColumn("full", F.lit(None).cast("struct<size: bigint, digest: string>")).unionByName(found)
    out = [
        F.col("capture"), F.col("request"), F.col("response"), F.col("metadata"),
        F.coalesce("full.size", "response.size").alias("payload_bytes"), F.coalesce("full.digest", "response.digest").alias("payload_digest"),
    ]
    if not with_payload:
        return whole.select(*out)
    payloads = full.groupBy("target").agg(F.any_value("payload").alias("full_payload"))
    return whole.join(payloads, "target", "left").select(*out, F.coalesce("full_payload", "payload").alias("payload"))


def page_of(record: Column) -> Column:
    """The page_id in a record's name; null if its page had none."""
    return F.regexp_extract(record, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
