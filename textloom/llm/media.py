"""Media columns: 8-bit grey PNG images in binary columns, and a perceptual hash of each.

A payload becomes an image 64 samples wide. Writing: rows are filtered (by the row above where most samples repeat,
else not), deflated, and cut into chunks with checksums. Reading tests the signature, every chunk's checksum and
zlib's, undoes all five filter types with numpy, and hashes the lowest cosine-transform frequencies.

A null text counts as empty; every payload is at least 64 bytes. Rows that repeat give the same values. Long texts
are one image, however high; an empty table gives an empty table; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import textops as T
from .common import materialize

WIDTH = 64
LEVEL = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def write_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    use = (up == 0).sum(axis=1) * 2 > width
    use[:1] = False
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = np.where(use, 2, 0)
    out[:, 1:] = np.where(use[:, None], up, rows)
    body = zlib.compress(out.tobytes(), LEVEL)
    data = b"".join(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of 8-bit grey rows with the given filter types."""
    out = rows.copy()
    if not kinds.any():
        return out
    plain = kinds == 0
    left = kinds == 1
    out[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    todo = np.flatnonzero(~(plain | left))
    run = 0
    while run < len(todo):
        y = int(todo[run])
        above = out[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
        if kinds[y] == 2:  # a run of such rows at once
            end = run + 1
            while end < len(todo) and todo[end] == todo[end - 1] + 1 and kinds[todo[end]] == 2:
                end += 1
            out[y : y + end - run] = above + np.cumsum(rows[y : y + end - run], axis=0, dtype=np.uint8)
            run = end
            continue
        if kinds[y] not in (3, 4):
            raise ValueError(f"unknown PNG filter type {kinds[y]}")
        a = c = 0
        for x, (v, b) in enumerate(zip(rows[y].tolist(), above.tolist(), strict=True)):
            if kinds[y] == 3:
                a = (v + (a + b) // 2) & 255
            else:
                p = a + b - c
                pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
                a, c = (v + (a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c)) & 255, b
            out[y, x] = a
        run += 1
    return out


def read_png(blob: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG. Raises ValueError if a checksum or the structure is wrong."""
    if blob[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(blob):
            raise ValueError("PNG ends early")
        n, kind = struct.unpack_from(">I4s", blob, at)
        body = blob[at + 8 : at + 8 + n]
        if len(blob) < at + 12 + n or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", blob, at + 8 + n)[0]:
            raise ValueError(f"PNG chunk {kind!r}: wrong checksum")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("only 8-bit grey PNG without interlace")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None:
        raise ValueError("PNG without IHDR")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if raw.size != size[0] * (size[1] + 1):
        raise ValueError("PNG: wrong amount of data")
    raw = raw.reshape(size[0], size[1] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(image: np.ndarray) -> str:
    """64 bits, as hex: which of the 8 x 8 lowest cosine frequencies of the image, at 32 x 32, lie above their median."""
    for axis in (0, 1):
        n = image.shape[axis]
        at = np.arange(_SIDE) * n // _SIDE
        if n >= _SIDE:
            total = np.add.reduceat(image.astype(np.float64), at, axis=axis)
            size = np.diff(np.append(at, n)).reshape((-1, 1) if axis == 0 else (1, -1))
            image = total / size
        else:
            image = np.take(image, at, axis=axis).astype(np.float64)
    low = np.round(_COS @ image @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a PNG) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            texts = pc.fill_null(b.column("text").cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_png(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload and media digests, and the cosine hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for blob in b.column("media").to_pylist():
                image = read_png(blob)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(image)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialize(spark, encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
