"""Substring dedup with prefix-partitioned suffix trees over words.

Every word position of a document with ``k`` words after it starts a suffix; below depth ``k`` (13 words) nothing
matters, so a suffix is its path of k words, held as a 64-bit path hash. Suffixes are dealt out by variable-length
prefixes: a first pass counts, over all data, how many suffixes begin with each 1, 2, 4 and 8 words (in hashed
bins), and a suffix goes by the shortest of these prefixes whose bin fits the memory of a group; if none does, by
its whole path. Bins are packed into groups of a bounded number of suffixes. A group sorts its paths, as a depth-first
walk of its subtree would meet them; a run of equal paths is an internal node of depth k with two leaves or more,
whose smallest document keeps the words while the other leaves lose them. Consecutive windows found this way merge
into the maximal repeats.

Hot passages: each block of documents first finds its own repeats and sends just the smallest document of a path,
so a group gets a path once per block, however many documents hold it. Shuffled per suffix: about 8 bytes.

Null and empty texts have no words. Rows with a null doc_id count as larger than all others. Rows that repeat with
the same doc_id don't remove each other's words. Texts of fewer than k words stay whole; long ones are
taken whole. An empty table gives an empty table. doc_id must be castable to a whole number; columns beside it and text are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import NULL_ID, materialize

K = 13
DEPTHS = (1, 2, 4, 8)
BINS = 4096
#: Suffixes that a group may hold, and that a block of documents gathers before it deals them out.
GROUP = 1 << 20
BLOCK = 3 << 19


def _bins(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Bin of the prefix of each depth for the suffixes that begin at the words ``at``."""
    return [(T.window_hashes(h, d)[at] >> T.U(40)).astype(np.int64) % BINS for d in DEPTHS]


def prefix_counts(docs: DataFrame, k: int = K) -> DataFrame:
    """depth, bin, n: how many suffixes begin with a prefix of the bin. One bounded histogram per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(DEPTHS), BINS), np.int64)
        for b in T.slices(batches):
            w = T.words_of(b.column("text"), lower=False)
            at, _ = T.inner_windows(w.first, k)
            if len(at):
                for i, x in enumerate(_bins(w.hashes(), at)):
                    n[i] += np.bincount(x, minlength=BINS)
        d, x = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(x, pa.int32()), pa.array(n[d, x], pa.int64())], names=["depth", "bin", "n"])

    return docs.select("text").mapInArrow(run, "depth int, bin int, n long").groupBy("depth", "bin").agg(F.sum("n").alias("n"))


def plan_groups(rows: list, size: int) -> tuple[np.ndarray, int, int]:
    """Group of each (depth, bin), -1 where it is too large; number of packed groups; number of groups for whole paths."""
    n = np.zeros((len(DEPTHS), BINS), np.int64)
    for r in rows:
        n[r.depth, r.bin] = r.n
    group = np.full(n.shape, -1, np.int32)
    filled, g = 0, 0
    for d, x in sorted(zip(*np.nonzero((n > 0) & (n <= size)), strict=True)):
        if filled and filled + n[d, x] > size:
            filled, g = 0, g + 1
        group[d, x] = g
        filled += n[d, x]
    return group, g + 1, max(1, int(n[0].sum()) // size + 1)


def repeated_windows(spark: SparkSession, docs: DataFrame, k: int = K, group_size: int = GROUP) -> DataFrame:
    """A row per document with any: key (doc_id, nulls as NULL_ID) and the path hashes whose windows a document with a smaller key also has."""
    table, packed, whole = plan_groups(prefix_counts(docs, k).collect(), group_size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            path, doc, gid = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
            by = np.argsort(path)
            path, doc, gid = path[by], doc[by], gid[by]
            del by
            at, size = T.runs(path)
            least = np.minimum.reduceat(doc, at)
            lost = doc > np.repeat(least, size)
            out: list[tuple] = []
            if lost.any():
                local, mine = path[lost], doc[lost]
                order = np.lexsort((local, mine))
                local, mine = local[order], mine[order]
                first, many = T.runs(mine)
                out += [(-1 - int(mine[a]) % 997, T.pack_sorted(np.unique(local[a : a + m])), mine[a : a + 1].tobytes()) for a, m in zip(first.tolist(), many.tolist(), strict=True)]
            path, gid = path[at], gid[at]
            order = np.argsort(gid, kind="stable")
            path, gid, doc = path[order], gid[order], least[order]
            first, many = T.runs(gid)
            for a, m in zip(first.tolist(), many.tolist(), strict=True):
                names, index = np.unique(doc[a : a + m], return_inverse=True)
                small = np.dtype("<u2" if len(names) < 1 << 16 else "<u4")
                out.append((int(gid[a]), T.pack_sorted(path[a : a + m]), names.astype("<i8").tobytes() + b"|" + index.astype(small).tobytes() + len(names).to_bytes(8, "little")))
            for i in range(0, len(out), 500):
                g, p, d = zip(*out[i : i + 500], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(p, pa.binary()), pa.array(d, pa.binary())], names=["gid", "paths", "docs"])

        for b in T.slices(batches):
            w = T.words_of(b.column("text"), lower=False)
            at, doc = T.inner_windows(w.first, k)
            if not len(at):
                continue
            h = w.hashes()
            path = T.window_hashes(h, k)[at]
            gid = np.full(len(at), -1, np.int32)
            for i, x in enumerate(_bins(h, at)):
                gid = np.where(gid < 0, table[i][x], gid)
            gid = np.where(gid < 0, packed + (path % T.U(whole)).astype(np.int32), gid)
            held.append((path, T.ids_of(b.column("key"), NULL_ID)[doc], gid))
            n += len(at)
            if n >= BLOCK:
                yield from flush()
        if n:
            yield from flush()

    buckets = max(8, whole // 8)

    def subtree(key: tuple, t: pa.Table) -> pa.Table:
        """Finds the repeats of a group, and sends them on in few rows, by buckets of documents."""
        if key[0].as_py() < 0:
            ids = np.frombuffer(b"".join(t.column("docs").to_pylist()), "<i8")
            sets = [T.unpack_sorted(x) for x in t.column("paths").to_pylist()]
            path, doc = np.concatenate(sets), np.repeat(ids, [len(x) for x in sets])
        else:
            paths, docs = [], []
            for p, d in zip(t.column("paths").to_pylist(), t.column("docs").to_pylist(), strict=True):
                names = int.from_bytes(d[-8:], "little")
                index = d[8 * names + 1 : -8]
                paths.append(T.unpack_sorted(p))
                docs.append(np.frombuffer(d[: 8 * names], "<i8")[np.frombuffer(index, "<u2" if names < 1 << 16 else "<u4")])
            path, doc = np.concatenate(paths), np.concatenate(docs)
            by = np.argsort(path)
            path, doc = path[by], doc[by]
            at, size = T.runs(path)
            lost = doc > np.repeat(np.minimum.reduceat(doc, at), size)
            path, doc = path[lost], doc[lost]
        bucket = doc % buckets
        by = np.lexsort((path, doc, bucket))
        path, doc, bucket = path[by], doc[by], bucket[by]
        first, many = T.runs(bucket)
        return pa.table({
            "bucket": pa.array(bucket[first], pa.int64()),
            "paths": pa.array([path[a : a + m].tobytes() for a, m in zip(first.tolist(), many.tolist(), strict=True)], pa.binary()),
            "docs": pa.array([doc[a : a + m].tobytes() for a, m in zip(first.tolist(), many.tolist(), strict=True)], pa.binary()),
        })

    def gather(_: tuple, t: pa.Table) -> pa.Table:
        path = np.frombuffer(b"".join(t.column("paths").to_pylist()), T.U)
        doc = np.frombuffer(b"".join(t.column("docs").to_pylist()), "<i8")
        by = np.lexsort((path, doc))
        path, doc = path[by], doc[by]
        first, many = T.runs(doc)
        return pa.table({"key": pa.array(doc[first], pa.int64()), "paths": pa.array([T.pack_sorted(path[a : a + m]) for a, m in zip(first.tolist(), many.tolist(), strict=True)], pa.binary())})

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), "text")
    found = keyed.mapInArrow(deal, "gid long, paths binary, docs binary").groupBy("gid").applyInArrow(subtree, "bucket long, paths binary, docs binary")
    return found.groupBy("bucket").applyInArrow(gather, "key long, paths binary")


def with_repeats(spark: SparkSession, docs: DataFrame, k: int = K, group_size: int = GROUP) -> DataFrame:
    """doc_id, text, n_words, n_removed and kept (the kept words joined by one space) of every row of ``docs``."""
    hits = materialize(spark, repeated_windows(spark, docs, k, group_size), "repeats")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            w = T.words_of(b.column("text"), lower=False)
            blobs, texts = b.column("paths").to_pylist(), b.column("text").to_pylist()
            some = [i for i, x in enumerate(blobs) if x]
            path = T.window_hashes(w.hashes(), k) if some else None
            kept, removed = [], np.zeros(b.num_rows, np.int64)
            some = set(some)
            for i, text in enumerate(texts):
                words = (text or "").encode().split()
                if i in some:
                    a, n = int(w.first[i]), len(words)
                    lost = np.isin(path[a : a + n - k + 1], T.unpack_sorted(blobs[i]))
                    cover = np.zeros(n + 1, np.int64)
                    cover[: len(lost)] += lost
                    cover[k : k + len(lost)] -= lost
                    keep = np.cumsum(cover[:-1]) == 0
                    removed[i] = n - keep.sum()
                    words = compress(words, keep.tolist())
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"))
    return keyed.join(hits, "key", "left").select("doc_id", "text", "paths").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], k: int = K) -> list[tuple]:
    first: dict[tuple, int] = {}
    split = [(NULL_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for (given, _), (i, w) in zip(rows, split, strict=True):
        lost = {p for a in range(len(w) - k + 1) if first[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        out.append((given, len(w), len(lost), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in lost)).hexdigest()))
    return out
