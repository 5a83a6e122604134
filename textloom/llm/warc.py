"""WARC archives with an index, and coalesced reads.

Writing: a digest of every payload and the smallest page of each digest decide which record holds the payload
(response) and which refer to it (revisit). Each task writes one archive of gzip members to the shared folder under a
name of its own and returns the index rows: file, offset, length, URL, digest. Rows of a failed attempt are never
returned, so its file is never read.

Reading starts from the index: the rows wanted are sorted by file and offset, near ranges are read as one, and each
record is parsed and its payload tested against its digest.

The meeting of equal payloads is on digests alone, with a partial aggregate; a digest of many pages is one row there,
and the join back is on 40-byte rows. Null html counts as empty. A null page_id counts as larger than all others. Of
repeated rows with the smallest page_id each is a response. Pages of any length are one record; an empty table gives an
empty table; columns beside page_id, url and html are not looked at. page_id must be castable to a whole number.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, materialize, new_path

DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges with a smaller gap are read as one, up to so many bytes.
GAP, READ = 1 << 16, 8 << 20
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes, from built-in functions."""
    digits = F.sha1(text)
    out = []
    for i in range(8):  # 5 hex digits are 4 base32 digits
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (F.shiftright(n, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def plan_records(spark: SparkSession, pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id (nulls as NULL_ID), url, html, digest, and the page that holds the payload."""
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page")
    html = F.coalesce("html", F.lit(""))
    heads = materialize(spark, pages.select(key, base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes")), "digests")
    first = heads.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = heads.where(F.col("bytes") >= least_bytes).join(first, "digest").where("page <> first").select("page", "digest", "first").distinct()
    return pages.select(key, "url", html.alias("html")).withColumn("digest", base32_sha1(F.col("html"))).join(revisits, ["page", "digest"], "left")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int, url: str | None, html: bytes, digest: str, first: int | None) -> bytes:
    body = HTTP if first is not None else HTTP + html
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {page}", f"X-Payload-Length: {len(html)}"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """A row of RECORD. Raises ValueError if the record is not whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    f = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    if lines[0] != "WARC/1.1" or len(rest) != int(f["Content-Length"]) + 4:
        raise ValueError("WARC record is not whole")
    payload, digest = rest[:-4].partition(b"\r\n\r\n")[2], f["WARC-Payload-Digest"].removeprefix("sha1:")
    first, page = f.get("X-Refers-To-Page-Id"), int(f["X-Page-Id"])
    if first is None and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(f["X-Payload-Length"])):
        raise ValueError("WARC payload does not match its digest")
    return (None if page == NULL_ID else page, int(f["X-Payload-Length"]), digest, f["WARC-Type"], None if first is None else int(first), f.get("WARC-Target-URI"), None if first is not None else payload.decode())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    cols = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), cols, strict=True)], names=[n for n, _ in cols])


def write_archives(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and returns their index, itself a written table."""
    folder = new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, at = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                path = f"{path}/{uuid.uuid4().hex}.warc.gz"
                out = system.open_output_stream(path, compression=None)
                file = f"{folder}/{path.rpartition('/')[2]}"
            rows = []
            for page, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "digest", "first")), strict=True):
                data = _member(record(page, url, html.encode(), digest, first))
                out.write(data)
                rows.append((file, at, len(data), url, digest, None if page == NULL_ID else page, "response" if first is None else "revisit"))
                at += len(data)
            yield _batch(rows, INDEX)
        if out is not None:
            out.close()

    planned = plan_records(spark, pages, least_bytes).select("page", "url", "html", "digest", "first")
    return materialize(spark, planned.mapInArrow(run, INDEX), "index")


def read_records(wanted: DataFrame) -> DataFrame:
    """The records of index rows, by coalesced byte-range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, source = None, None
        for b in batches:
            ranges = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(ranges):
                file, start, n = ranges[i]
                end, j = start + n, i + 1
                while j < len(ranges) and ranges[j][0] == file and ranges[j][1] - end <= GAP and ranges[j][1] + ranges[j][2] - start <= READ:
                    end = max(end, ranges[j][1] + ranges[j][2])
                    j += 1
                if file != name:
                    system, path = fs.FileSystem.from_uri(file)
                    name, source = file, system.open_input_file(path)
                data = source.read_at(end - start, start)
                yield _batch([parse(zlib.decompress(data[o - start : o - start + m], 31)) for _, o, m in ranges[i:j]], RECORD)
                i = j

    files = max(1, wanted.select("file").distinct().count())  # a given number of partitions isn't merged, small as the index is
    return wanted.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
