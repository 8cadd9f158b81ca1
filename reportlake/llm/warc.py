"""WARC in seekable Zstandard bundles.

Records are grouped into independent frames of about 1 MB; each bundle ends with an index from record identifier
to frame and frame-relative offset, and a seek table (frames.py). Of pages with equal payloads the one with the
smallest page_id becomes a response, the others revisit it. Equality is that of the payload's SHA-1. Which page
responds is settled on narrow rows (identifier, digest); the html itself moves once, by page_id, never by digest,
so a payload that a third of the pages share loads no single task.

A bundle begins with a warcinfo record, which is not among the records read back.

Defined cases: a null html is an empty payload, and empty payloads revisit each other like any; a null url
becomes urn:page:<id>; a null page_id gets a record identifier of its own and comes back null; page_id is the key of
records, so rows that repeat it have records of one identifier; rows that repeat both identifier and payload of a
response are responses too; very long pages are frames of their own; an empty table gives no bundle and no rows;
payloads below ``least`` bytes are always responses; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, scratch, written
from .frames import Reader, Writer

NULL_ID, INFO_ID = -(1 << 63), 1 - (1 << 63)
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One WARC/1.1 record; response: the page that it revisits, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if response is None else b"")
    uri = "".join((url or f"urn:page:{page}").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{f'null:{uuid.uuid4().hex}' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if response is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The record that a bundle begins with."""
    block = b"software: reportlake\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of a record; a damaged one raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return {"warc": fields, "http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha1 (hex), response: the page that answers for the payload (null where it is the only one)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("n"))
    # Written, so that the join by digest has an exchange at either side: it is split where a third of the pages are equal.
    shared = written(
        keyed.where(F.col("n") >= least).groupBy("sha1").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and response is not null").drop("copies"),
        "warc-shared",
    )
    return keyed.join(shared, "sha1").where("page_id is not null and page_id <> response").select("page_id", "sha1", "response").distinct()


def write_bundles(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each page; the manifest of bundles (part, uri, records, bytes), held by the driver."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    joined = rows.join(roles(pages, least), ["page_id", "sha1"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri = f"{folder}/bundle-{part:06d}-{uuid.uuid4().hex}.warc.zst"
        out, n = None, 0
        for b in batches:
            for page, sha1, url, data, response in zip(*(b.column(i) for i in range(5)), strict=True):
                page, response = page.as_py(), response.as_py()
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                if out is None:
                    out = Writer(uri)
                    out.add(INFO_ID, info(uri.rpartition("/")[2]))
                out.add(NULL_ID if page is None else page, record(page, url.as_py(), data.as_py(), digest, response))
                n += 1
        if out:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "records": [n], "bytes": [out.close()]})

    done = joined.select("page_id", "sha1", "url", "payload", "response").mapInArrow(run, "part int, uri string, records long, bytes long").collect()
    return spark.createDataFrame([tuple(r) for r in done], "part int, uri string, records long, bytes long")


def read_bundles(manifest: DataFrame, keys: list[int] | None = None) -> DataFrame:
    """Records of the bundles, or those of some identifiers, whose frames alone are decompressed.

    payload_bytes and payload_digest are taken from the payload itself where the record has it, and else from
    the revisit's headers; a response whose digest does not fit its payload raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for uri in b.column(0).to_pylist():
                reader = Reader(uri)
                for key, data in reader.pieces(keys):
                    if key == INFO_ID:
                        continue
                    r = parse(data)
                    said = r["warc"]["WARC-Payload-Digest"].removeprefix("sha1:")
                    if (kind := r["warc"]["WARC-Type"]) == "response":
                        n, digest, refers = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode(), None
                        if digest != said:
                            raise ValueError(f"record {key} is damaged")
                    else:
                        n, digest = int(r["http"]["Content-Length"]), said
                        refers = int(r["warc"]["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
                    out.append((None if key == NULL_ID else key, n, digest, kind, refers))
                    if len(out) == 2000:
                        yield _rows(out)
                        out = []
                reader.close()
        if out:
            yield _rows(out)

    return manifest.select("uri").mapInArrow(run, RECORD)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d, e = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.string()), pa.array(e, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to bundles in the shared folder and read the records back."""
    spark: SparkSession = pages.sparkSession
    manifest = write_bundles(pages, scratch(spark, "warc"), least)
    n = manifest.count()
    return read_bundles(manifest.repartition(max(1, min(n, partitions(pages))), "uri"))
