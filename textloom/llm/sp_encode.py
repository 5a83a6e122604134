"""SentencePiece encoding and decoding of a byte-fallback BPE model, by suffix-array matching.

A text is cut into chunks, a run of spaces and what follows up to the next space; no piece reaches over a chunk's
start, so chunks are encoded alone and each worker remembers them. The new chunks of a batch are joined to one text
whose suffix array is binary-searched for every piece at once; the ranges give every occurrence of every piece as an
edge, and the edges, sorted by position, are the lattice. Relaxing it for a BPE model means to merge, in each chunk,
the two neighbouring segments whose joint edge scores best (leftmost on ties), until no joint edge is left; all chunks
advance one merge a round. Characters without an edge become byte pieces.

The lattice's best path by summed scores (Viterbi) is not what this model kind computes, hence merges; results equal
the sentencepiece library's.

A null text counts as empty, and an empty one has no ids. Repeated rows give the same values. Long texts are encoded
whole, a chunk of n characters in memory of about 150 n bytes; equal scores go to the leftmost pair; an empty table gives
an empty table; columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks that a worker remembers, and bytes of text that it takes at once.
CACHE, BATCH = 400_000, 3 << 19
#: Chunks longer than this are merged one by one with a heap.
LONG = 200


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = b[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, b[i : i + n]
            i += n


class Model:
    """Pieces, scores and kinds of a model file: kind 1 is normal, 6 a byte."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
        self.pieces = [r[1].decode() for r in raw]
        self.scores = np.array([struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in raw])
        kinds = [r.get(3, 1) for r in raw]
        self.byte_ids = np.zeros(256, np.int32)
        decoded = []
        for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)):
            if k == 6:
                self.byte_ids[int(p[3:5], 16)] = i
            decoded.append(bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() if k == 1 else b"")
        self.normal = np.array([i for i, k in enumerate(kinds) if k == 1], np.int32)
        self.longest = max(len(self.pieces[i]) for i in self.normal.tolist())
        self.length = np.array([len(self.pieces[i]) for i in self.normal.tolist()], np.int64)
        self.codes = np.zeros((len(self.normal), self.longest), np.int64)
        for row, i in enumerate(self.normal.tolist()):
            p = self.pieces[i]
            self.codes[row, : len(p)] = [ord(c) for c in p]
        self.out_size = np.array([len(d) for d in decoded], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(decoded), np.uint8)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the first ``depth`` symbols of their suffixes, by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank + 1
    step, order = 1, np.argsort(rank, kind="stable")
    while step < depth:
        later = np.zeros(len(rank), np.int64)
        later[:-step] = rank[step:]
        key = rank * (len(rank) + 2) + later
        order = np.argsort(key)
        new = np.concatenate([[1], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    return order


def piece_ranges(text: np.ndarray, sa: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Range of suffixes that begin with each piece, by binary search of all pieces at once."""
    n, width = len(text), m.longest
    padded = np.concatenate([text, np.zeros(width, np.int64)])
    offsets = np.arange(width)
    inside = offsets[None, :] < m.length[:, None]
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(m.length), np.int64), np.full(len(m.length), n)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            suffix = padded[sa[np.minimum(mid, n - 1)][:, None] + offsets]
            differ = (suffix != m.codes) & inside
            first = np.argmax(differ, axis=1)
            rows = np.arange(len(mid))
            none = ~differ[rows, first]
            less = np.where(none, upper, suffix[rows, first] < m.codes[rows, first])
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


def lattice(text: np.ndarray, m: Model) -> np.ndarray:
    """Piece of each edge, by position * (longest + 1) + length; -1 where there is none."""
    sa = suffix_array(text, m.longest)
    lo, hi = piece_ranges(text, sa, m)
    n = hi - lo
    small = np.int32 if (len(text) + 1) * (m.longest + 1) < 1 << 31 else np.int64
    key = sa.astype(small)[np.repeat((lo - (np.cumsum(n) - n)).astype(small), n) + np.arange(n.sum(), dtype=small)]
    del sa
    key *= small(m.longest + 1)
    key += np.repeat(m.length.astype(small), n)
    by = np.argsort(key)  # edges by position
    out = np.full((len(text) + 1) * (m.longest + 1), -1, np.int32)
    out[key[by]] = np.repeat(m.normal, n)[by]
    return out


def _merge_long(start: int, end: int, edges: np.ndarray, m: Model) -> list[int]:
    """Starts of the segments of one long chunk."""
    wide = m.longest + 1
    after = {i: i + 1 for i in range(start, end)}
    before = {i: i - 1 for i in range(start + 1, end)}

    def pair(i: int) -> tuple | None:
        j = after.get(i, end)
        if j >= end or after[j] - i > m.longest or (p := edges[i * wide + after[j] - i]) < 0:
            return None
        return -m.scores[p], i, j, after[j]

    heap = [x for i in range(start, end) if (x := pair(i))]
    heapify(heap)
    while heap:
        _, i, j, k = heappop(heap)
        if after.get(i) != j or after.get(j) != k:
            continue
        after[i] = k
        del after[j]
        before.pop(j, None)
        if k < end:
            before[k] = i
        for x in (i, before.get(i)):
            if x is not None and (p := pair(x)):
                heappush(heap, p)
    return sorted(after)


def relax(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the final segments, ascending, and the chunk of each."""
    wide, size = m.longest + 1, ends - starts
    done_at, done_chunk = [], []
    for c in np.flatnonzero(size > LONG).tolist():
        segments = _merge_long(int(starts[c]), int(ends[c]), edges, m)
        done_at.append(np.array(segments, np.int64))
        done_chunk.append(np.full(len(segments), c))
    some = np.flatnonzero(size <= LONG)
    n = size[some]
    chunk = np.repeat(some, n)
    at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    while len(at):
        stop = np.append(at[1:], 0)
        last = np.append(chunk[1:] != chunk[:-1], True)
        stop[last] = ends[chunk[last]]
        reach = np.append(stop[1:], 0) - at
        piece = edges[at * wide + np.where(last | (reach > m.longest) | (reach < 1), 0, reach)]
        worth = np.where(last | (piece < 0), -np.inf, m.scores[piece])
        first, many = T.runs(chunk)
        best = np.maximum.reduceat(worth, first)
        live = np.repeat(best > -np.inf, many)
        done_at.append(at[~live])
        done_chunk.append(chunk[~live])
        hit = np.flatnonzero(live & (worth == np.repeat(best, many)))
        hit = hit[np.append(True, chunk[hit][1:] != chunk[hit][:-1])] if len(hit) else hit
        live[hit + 1] = False  # the right one of a pair joins the left one
        at, chunk = at[live], chunk[live]
    at, chunk = np.concatenate(done_at), np.concatenate(done_chunk)
    by = np.argsort(at, kind="stable")
    return at[by], chunk[by]


def encode_chunks(chunks: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks and how many each has. Chunks have SPACE for a space."""
    size = np.array([len(c) for c in chunks], np.int64)
    text = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
    ends = np.cumsum(size)
    edges = lattice(text, m)
    at, chunk = relax(ends - size, ends, edges, m)
    stop = np.append(at[1:], len(text))
    ids = edges[at * (m.longest + 1) + np.minimum(stop - at, m.longest)]
    count = np.ones(len(ids), np.int64)
    bare = np.flatnonzero(ids < 0)
    spelled = [chr(c).encode() for c in text[at[bare]].tolist()]
    count[bare] = [len(s) for s in spelled]
    out = np.repeat(ids, count)
    out[out < 0] = m.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    return out, np.bincount(chunk, count, len(chunks)).astype(np.int64)


class Encoder:
    def __init__(self, path: str):
        self.model = Model(path)
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' limits."""
        texts = pc.replace_substring(pc.fill_null(col.cast(pa.large_string()), ""), SPACE, " ")
        empty = pa.scalar("", pa.large_string())
        texts = pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(empty, texts, pa.scalar(" ", pa.large_string())))
        data, off = T.bytes_of(texts)
        space = data == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(begin)
        w = T.Words(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, off))
        if len(self.known) > CACHE:
            self.reset()
        uniq, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
        keys = uniq.tolist()
        entry = np.fromiter((self.known.get(x, -1) for x in keys), np.int64, len(keys))
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            chunks = [raw[a:b].decode().replace(" ", SPACE) for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)]
            ids, size = encode_chunks(chunks, self.model)
            entry[new] = np.arange(len(self.size), len(self.size) + len(new))
            self.known.update(zip((keys[i] for i in new.tolist()), entry[new].tolist(), strict=True))
            self.start = np.append(self.start, len(self.pool) + np.cumsum(size) - size)
            self.size, self.pool = np.append(self.size, size), np.append(self.pool, ids)
        seq = entry[inverse]
        size = self.size[seq]
        end = np.cumsum(size)
        at = np.repeat(self.start[seq] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        return self.pool[at], np.concatenate([[0], end])[w.first].astype(np.int64)

    def decode(self, ids: np.ndarray, limits: np.ndarray) -> list[str]:
        m = self.model
        size = m.out_size[ids]
        end = np.cumsum(size)
        raw = m.out_bytes[np.repeat(m.out_start[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        at = np.concatenate([[0], end])[limits].tolist()
        return [raw[a:b].decode(errors="replace")[1:] for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and decoded (the ids turned back to text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in T.slices(batches, max_bytes=BATCH):
            ids, limits = enc.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids, pa.int32())), pa.array(enc.decode(ids, limits), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and decoded_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, raw = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4")
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), b.column("decoded_sha256")], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    encoded = encode_documents(docs, model).select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return encoded.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, decoded_sha256 string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(MODEL))
