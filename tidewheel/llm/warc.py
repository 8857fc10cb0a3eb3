"""WARC archives: a writer on Spark's own file sink and a splittable reader.

Writing: a record is one gzip member. Equal payloads of at least ``LEAST_REVISIT`` bytes are stored once, by the
smallest page_id; others become revisit records that refer to it. Members go out through Spark's text sink, whose
commit protocol survives lost executors and which writes to any store: every member ends in a zero byte (the top of its
length), which the sink adds as its line end.

Reading: tasks get byte ranges. Each scans its range for the gzip magic, takes a candidate only if it decodes to a WARC
header, owns the records that start inside its range, and reads past its end to finish the last one. ``read`` takes any
archive of one gzip member a record, with records of every type, and computes digests again; ``read_pages`` takes what
``write`` wrote, where each must match its header.

Edge cases: a null html is an empty payload; a null url is an empty target; a null page_id may refer to others but is
referred to by none. Repeated rows of one page_id are responses each. Payloads under the limit are always responses.
An empty table gives an empty archive. Further columns are ignored. Records without a header that ``read`` returns have null
there; a header that is no UTF-8 is decoded with replacement characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow, map_arrow

LEAST_REVISIT = 100
SPLIT_BYTES = 16 << 20
BLOCK = 1 << 18
MAGIC = b"\x1f\x8b\x08"
#: An archive names no time of its own: pages have none.
DATE = "1970-01-01T00:00:00Z"
_EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record of one page."""
    target = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte; one whose length has another top byte is followed by an empty member."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def write(pages: DataFrame, path: str) -> None:
    """Write pages(page_id, url, html) as WARC records to files in path."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(Scratch(pages.sparkSession).keep(firsts, True), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") < F.col("page_id")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [member(record(*row))[:-1] for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["member"])

    map_arrow(rows, run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class Ranged:
    """A file's bytes by position, fetched in blocks from any store that pyarrow opens."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
        self.file = system.open_input_file(name)

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def close(self) -> None:
        self.file.close()


def decode_at(file: Ranged, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at a position, None if it is none that holds a WARC record or nothing."""
    z, parts, checked, size, block = zlib.decompressobj(31), [], 0, at, 1 << 14
    try:
        while not z.eof:
            data = file.read(size, block)
            if not data:
                return None
            size += len(data)
            out = z.decompress(data)
            parts.append(out)
            checked += len(out)
            if checked >= 5 and parts[0][:5] != b"WARC/" and b"".join(parts)[:5] != b"WARC/":
                return None
            block = BLOCK
    except zlib.error:
        return None
    return b"".join(parts), size - len(z.unused_data)


def members(file: Ranged, start: int, end: int) -> Iterator[bytes]:
    """The contents of the members that start in [start, end)."""
    at = start
    while at < end:
        data = file.read(at, min(BLOCK, end - at) + len(MAGIC) - 1)
        k = data.find(MAGIC)
        if k < 0 or at + k >= end:
            at += max(len(data) - len(MAGIC) + 1, 1) if len(data) >= len(MAGIC) else end - at
            continue
        found = decode_at(file, at + k)
        if found is None:
            at += k + 1
        else:
            if found[0]:
                yield found[0]
            at = found[1]


def parse(data: bytes) -> dict[str, str | bytes]:
    """The headers (lower case) of a record, and its block under ''. A line that begins with white space goes on with the one before."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    found: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = found.get("content-length", "")
    found[""] = rest[: int(size)] if size.isdecimal() else rest
    return found


def payload_of(record: dict) -> bytes:
    """What a record's HTTP message carries; the whole block where it is no HTTP message."""
    block = record[""]
    return block.partition(b"\r\n\r\n")[2] if record.get("content-type", "").lower().startswith("application/http") and block[:5] == b"HTTP/" else block


def agrees(payload: bytes, named: str | None) -> bool | None:
    """Whether payload has the named digest (algorithm:hex or base32); None where none, or one of another algorithm, is named."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own = hashlib.new(kind.lower(), payload)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """(record_id, url, record_type, payload_bytes, payload_digest, refers_to, intact[, payload]) of every record in the files of path.

    payload_digest is the payload's SHA-256; of a revisit the digest that its header names, and payload_bytes the length
    that it names, if any. intact says whether the payload has the digest of its header, null where that can't be told.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(starts.count(), 1)
    ranges = starts.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")).repartitionByRange(n, "path", "start")
    fields = [("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("intact", pa.bool_())]
    kept = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(kept), kept)], schema=kept)

        for batch in batches:
            for name, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                file, rows, held = Ranged(name), [], 0
                for data in members(file, start, end):
                    x = parse(data)
                    kind, named, payload = x.get("warc-type"), x.get("warc-payload-digest"), payload_of(x)
                    if kind == "revisit":
                        size = x.get("warc-payload-length", "")
                        found = (int(size) if size.isdecimal() else None, named.removeprefix("sha256:") if named else None, x.get("warc-refers-to"), None)
                    else:
                        found = (len(payload), hashlib.sha256(payload).hexdigest(), x.get("warc-refers-to"), agrees(payload, named))
                    rows.append((x.get("warc-record-id"), x.get("warc-target-uri"), kind, *found, *([payload] if with_payload else [])))
                    held += len(payload)
                    if len(rows) >= 1000 or held >= 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)
                file.close()

    arrow(spark)
    return ranges.mapInArrow(run, "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, intact boolean" + ", payload binary" * with_payload)


def read_pages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of what ``write`` wrote; a payload without its digest is an error."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")
    found = read(spark, path, split_bytes, with_payload)
    whole = F.when(F.coalesce("intact", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.col("record_id"), F.lit(" does not match its digest"))))
    return found.select(page("record_id").alias("page_id"), "url", "record_type", "payload_bytes", whole.alias("payload_digest"), page("refers_to").alias("refers_to"), *["payload"] * with_payload)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    path = Scratch(pages.sparkSession).new()
    write(pages, path)
    return read_pages(pages.sparkSession, path, with_payload=with_payload)


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest"""
