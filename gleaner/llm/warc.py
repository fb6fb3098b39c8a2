"""Writing pages as WARC archives, and assembling captures from archives.

A capture is three records: a request, a response (or a revisit, where an
equal payload has been written under a smaller page id) and a metadata record.
Request and metadata name the response in ``WARC-Concurrent-To``; reading
joins the three by that identifier, in whatever files and order they are, and
emits one nested row a capture.

Every record is a gzip member of its own, so archives can be read from any
offset at which one begins.  A file holds members of ``FILE_BYTES`` together,
or a single longer one.  Spark's text writer puts them into any store that it
reaches: a member ends in a zero byte, which is the writer's line end.
Reading decompresses and parses a file piece by piece; archives that others
have compressed as a whole are read as well.

Defined results: a null html is an empty payload; rows with equal page ids are
captures of their own; a null page id is never the original of others; a null
url is an empty target; line ends in a url are left out; a capture without
response or revisit has a null one; an empty table gives no captures; other
columns of ``pages`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import lookup_join, small_batches
from gleaner.scratch import materialize, scratch_path

END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of an archive file, which a reading task holds whole, and bytes that it decompresses or returns at a time.
FILE_BYTES, PIECE_BYTES = 32 << 20, 1 << 20
LEVEL = 4
# fixed values of RFC 4648: the digits of base 32, and those that Spark's conv writes
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of binary: each five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), CONV32, BASE32)


def record(kind: str | Column, headers: list[Column], block: Column) -> Column:
    """A record without the line ends after it."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit(""), block]
    return F.concat_ws(END, *lines)


def header(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def member(data: bytes) -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def bundles(records: DataFrame) -> DataFrame:
    """``value``: the members of consecutive records of a task, about ``FILE_BYTES`` a row, without the zero byte at their end."""
    empty = member(b"")

    def row(held: list[bytes]) -> pa.RecordBatch:
        if held[-1][-1]:  # the length of a record of 16 MB or more
            held.append(empty)
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column("value"):
                packed = member(value.as_py() + (END + END).encode())
                if held and size + len(packed) > FILE_BYTES:
                    yield row(held)
                    held, size = [], 0
                held.append(packed)
                size += len(packed)
        if held:
            yield row(held)

    small_batches(records.sparkSession)
    return records.select(F.col("value").cast("binary")).mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped archives into the folder ``path``."""
    html = F.coalesce("html", F.lit(""))
    named = pages.select(
        "page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), html.alias("html"), sha1_base32(html.cast("binary")).alias("digest"),
        F.octet_length(html).alias("bytes"), F.monotonically_increasing_id().alias("uid"),
    )
    named = materialize(named, "pages")  # the numbers of rows are those that revisits refer to
    able = named.where(F.col("bytes") >= min_revisit_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uid")))
    originals = able.groupBy("digest", "bytes").agg(first.alias("original"), F.count("*").alias("n")).where("n > 1")
    originals = materialize(originals.select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "original"), "originals")
    joined = lookup_join(named, originals, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")

    urn = lambda page, uid: F.concat_ws(":", F.lit("<urn:capture"), F.coalesce(page.cast("string"), F.lit("none")), uid.cast("string"))
    own = urn(F.col("page_id"), F.col("uid"))
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    target, date = header("WARC-Target-URI", F.col("url")), header("WARC-Date", DATE)
    own_id = lambda part: header("WARC-Record-ID", F.concat(own, F.lit(f":{part}>")))
    concurrent = header("WARC-Concurrent-To", F.concat(own, F.lit(":response>")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    answer = record(
        F.when(revisit, "revisit").otherwise("response"),
        [
            own_id("response"), target, date, header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), header("Content-Type", "application/http; msgtype=response"),
            F.when(revisit, header("WARC-Refers-To", F.concat(urn(F.col("original.page_id"), F.col("original.uid")), F.lit(":response>")))),
            F.when(revisit, header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    asked = record("request", [own_id("request"), target, date, concurrent, header("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{END}{END}")))
    about = record("metadata", [own_id("metadata"), target, date, concurrent, header("Content-Type", "application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(END)))
    records = joined.select(F.explode(F.array(asked, answer, about)).alias("value"))
    # bytes that a string column carries are written as they are
    bundles(records).select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def inflate(data: bytes) -> Iterator[bytes]:
    """What an archive holds, in pieces: gzip members one after the other, or uncompressed data."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES))
        return
    step, at = 1 << 15, 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof and at < len(data):
            piece = unpacker.decompress(data[at : at + step], PIECE_BYTES)
            at = min(at + step, len(data))
            yield piece
            while unpacker.unconsumed_tail:
                yield unpacker.decompress(unpacker.unconsumed_tail, PIECE_BYTES)
        at -= len(unpacker.unused_data)


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers, by lower-case names, and the block of each record of an archive."""
    held, fields, seen = bytearray(), None, 0
    for piece in pieces:
        held += piece
        while True:
            if fields is None:
                end = held.find(b"\r\n\r\n", max(0, seen - 3))
                if end < 0:
                    seen = len(held)
                    break
                fields = {}
                for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
                    name, _, value = line.partition(":")
                    fields[name.strip().lower()] = value.strip()
                size, seen = int(fields.get("content-length", 0)), 0
                del held[: end + 4]
            if len(held) < size + 4:  # the line ends after the block belong to it
                break
            yield fields, bytes(held[:size])
            del held[: size + 4]
            fields = None
    if fields is not None:  # an archive that is cut off
        yield fields, bytes(held[:size])


RECORD = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, payload_bytes long, payload_digest string, payload binary, fields string"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; digests of responses are those of the payload that was read."""

    def row(fields: dict[str, str], block: bytes) -> dict:
        kind, size, digest, payload = fields.get("warc-type"), None, None, None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            if kind == "revisit":
                sizes = [line[15:].strip() for line in http.split(b"\r\n") if line[:15].lower() == b"content-length:"]
                size, digest, payload = int(sizes[0]) if sizes else None, fields.get("warc-payload-digest", "").rpartition(":")[2], None
            else:
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return {
            "record_id": fields.get("warc-record-id"), "type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "concurrent_to": fields.get("warc-concurrent-to"),
            "refers_to": fields.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload if with_payload else None, "fields": block.decode("utf-8", "replace") if kind == "metadata" else None,
        }

    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.string()]
    schema = pa.schema([(c.split()[0], k) for c, k in zip(RECORD.split(", "), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for fields, block in parse(inflate(content.as_py())):
                    held.append(row(fields, block))
                    size += len(block) + 500
                    if size >= 4 * PIECE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    # a row of binaryFile is a whole file; one at a time goes to Python
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """``capture_id, request, response, metadata``: the records that are concurrent to a response or revisit, with it."""
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    whole = F.struct("record_id", "type", "target_uri", "date", "refers_to", "payload_bytes", "payload_digest", "payload")
    pick = lambda kinds, value: F.max_by(F.when(F.col("type").isin(*kinds), value), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return records.groupBy(key.alias("capture_id")).agg(
        pick(["request"], F.struct("record_id", "target_uri", "date")).alias("request"),
        pick(["response", "revisit"], whole).alias("response"),
        pick(["metadata"], F.struct("record_id", "fields")).alias("metadata"),
    )


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:capture:(-?[0-9]+):", 1).try_cast("long")


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return their captures, with the ``page_id`` that the metadata has and the page that a revisit refers to."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes)
    captures = assemble(read_records(pages.sparkSession, path, with_payload))
    page = F.regexp_extract("metadata.fields", "page-id: (-?[0-9]+)", 1).try_cast("long")
    return captures.withColumn("page_id", page).withColumn("refers_to", page_of(F.col("response.refers_to")))
