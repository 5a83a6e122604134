"""Words and word windows of whole Arrow batches as numpy arrays.

Words are found and hashed with a fixed number of numpy passes over a batch's bytes, so the cost is a few
nanoseconds a byte and no Python object is made per word. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            p = np.full(size, U(base), U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _powers[which] = both[0], both[1]
    p, q = _powers[which]
    return p[:n], q[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """data: the (lower-cased) bytes; starts, ends: of each word; first: index of each document's first word, and the number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        p, q = powers(0, len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * p[: len(self.data)], out=c[1:])
        return mix((c[self.ends] - c[self.starts]) * q[self.starts] + (self.ends - self.starts).astype(U) * U(0xA0761D6478BD642F))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and the texts' limits. A null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw else np.zeros(0, np.uint8)
    return data, off - off[0]


def words_of(col: pa.Array, table: np.ndarray = SPACE_WORDS, lower: bool = True) -> Words:
    data, off = bytes_of(col)
    if lower:
        data = LOWER[data]
    inside = table[data]
    edge = off[:-1][np.diff(off) > 0]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes, over all documents' words; the caller leaves out runs that cross documents."""
    if len(h) < k:
        return np.zeros(0, U)
    p, q = powers(1, len(h) + 1)
    c = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=c[1:])
    return mix((c[k:] - c[:-k]) * q[: len(h) - k + 1] + U(k * 0x8EBC6AF09C88C6E3 % 2**64))


def inner_windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the windows of k words that lie in one document, and their documents."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), doc


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about max_bytes of text at most, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def ids_of(col: pa.Array, null: int) -> np.ndarray:
    return pc.fill_null(col.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, one byte plane after another: the high planes compress to nothing."""
    if not len(keys):
        return b""
    d = np.empty(len(keys), "<u8")
    d[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=d[1:])
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.diff(np.append(at, len(sorted_keys)))
