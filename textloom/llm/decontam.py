"""Benchmark decontamination with an FM-index per training shard.

Each Arrow slice of documents (a few MB, the shard) becomes one symbol sequence: a word that the benchmark uses is
its vocabulary number, any other word and the gap between documents is a one-off separator. The shard's suffix
array, its Burrows-Wheeler transform, a wavelet matrix for ranks and a sample of suffix positions form the index.
All benchmark windows are searched backwards at once, their occurrences are located by walking to sampled
positions, and the covered words merge into removal spans. No shuffle: the benchmark is broadcast in blocks of
bounded size, whatever its total size, and every shard is searched for every block.

Null and empty texts have no words and no hits. A benchmark row without words has no window. Rows that repeat are
judged each on its own. A null item_id counts as the empty string. Long texts are
judged whole; items that tie on a window all count; an empty table gives an empty table, an empty benchmark no hits; other
columns pass through whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

WINDOW = 10
#: Windows in one broadcast block of the benchmark.
BLOCK_WINDOWS = 100_000
SAMPLE = 32
#: Bytes of text in a shard.
SHARD = 4 << 20


class Phrases:
    """One block of benchmark windows: vocab (sorted word hashes), the distinct windows as symbols, and their items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.vocab = np.unique(np.concatenate([h for _, h in items]))
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[bytes, set[int]] = {}
        for name, h in items:
            s = np.searchsorted(self.vocab, h).astype("<i4") + 1
            for at in range(max(1, len(s) - window + 1)):
                found.setdefault(s[at : at + window].tobytes(), set()).add(number[name])
        self.lengths = np.array([len(k) // 4 for k in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for row, key in enumerate(found):
            s = np.frombuffer(key, "<i4")
            self.symbols[row, window - len(s) :] = s
        self.items = [np.fromiter(sorted(v), np.int64) for v in found.values()]
        low = self.vocab & T.U(0xFFFF)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[low.astype(np.int64)] = True

    def symbols_of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(self.maybe[(h & T.U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[some]), len(self.vocab) - 1)
        hit = self.vocab[at] == h[some]
        out[some[hit]] = at[hit] + 1
        return out


class FMIndex:
    """Index of a sequence whose zeros are one-off separators; the last symbol is a zero."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        zero = np.flatnonzero(text == 0)
        z = len(zero)
        rank = np.empty(n, np.int64)
        rank[zero] = np.arange(z)
        live = np.flatnonzero(text)
        order = live[np.argsort(text[live], kind="stable")]
        at, size = T.runs(text[order])
        rank[order] = z + np.repeat(at, size)
        step = 1
        many = np.repeat(size > 1, size)
        where = np.flatnonzero(many)  # places of order that still share a rank
        while len(where):
            pos = order[where]
            key = (rank[pos].astype(T.U) << T.U(32)) | rank[pos + step].astype(T.U)
            by = np.argsort(key)
            pos, key = pos[by], key[by]
            order[where] = pos
            at, size = T.runs(key)
            rank[pos] = z + np.repeat(where[at], size)
            where = where[np.repeat(size > 1, size)]
            step *= 2
        sa = np.concatenate([zero, order])
        self.bwt = text[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.sampled = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.position = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.levels = []
        seq = self.bwt
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (seq >> bit) & 1 == 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((bit, ones, n - int(ones[-1])))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands among the first i[k] symbols of the transform."""
        lo = np.zeros(len(c), np.int64)
        for bit, ones, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            i1, l1 = ones[i], ones[lo]
            i = np.where(one, zeros + i1, i - i1)
            lo = np.where(one, zeros + l1, lo - l1)
        return i - lo

    def search(self, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and their ranges of rows."""
        last = p.symbols[:, -1]
        lo, hi, row = self.start[last].copy(), self.start[last + 1].copy(), np.arange(len(last))
        done = []
        for back in range(2, p.symbols.shape[1] + 2):
            some = hi > lo
            lo, hi, row = lo[some], hi[some], row[some]
            full = p.lengths[row] < back
            done.append((row[full], lo[full], hi[full]))
            lo, hi, row = lo[~full], hi[~full], row[~full]
            if not len(row):
                break
            c = p.symbols[row, -back]
            lo, hi = self.start[c] + self.rank(c, lo), self.start[c] + self.rank(c, hi)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        walked, at = 0, np.arange(len(rows))
        while len(rows):
            hit = self.sampled[rows]
            out[at[hit]] = self.samples[self.position[rows[hit]]] + walked
            rows, at = rows[~hit], at[~hit]
            c = self.bwt[rows]
            rows = self.start[c] + self.rank(c, rows)
            walked += 1
        return out


def find(words: T.Words, blocks: list) -> tuple[np.ndarray, list[set[str]]]:
    """Which words are hit, and for each document the items found in it."""
    h, first = words.hashes(), words.first
    docs = len(first) - 1
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(docs)]
    shift = words.doc_of()
    for block in blocks:
        p: Phrases = getattr(block, "value", block)
        s = p.symbols_of(h)
        if not s.any():
            continue
        text = np.zeros(len(h) + docs, np.int64)
        text[np.arange(len(h)) + shift] = s
        index = FMIndex(text, len(p.vocab))
        row, lo, hi = index.search(p)
        n = hi - lo
        if not n.sum():
            continue
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = index.locate(rows)
        which = np.repeat(row, n)
        doc = np.searchsorted(first + np.arange(docs + 1), at, side="right") - 1
        at = at - doc
        np.add.at(cover, at, 1)
        np.add.at(cover, at + p.lengths[which], -1)
        pairs = np.unique(doc * len(p.lengths) + which)
        for d, w in zip((pairs // len(p.lengths)).tolist(), (pairs % len(p.lengths)).tolist(), strict=True):
            items[d].update(p.names[i] for i in p.items[w])
    return np.cumsum(cover[:-1]) > 0, items


def spans_of(words: T.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged runs of hit words: document, first byte and end byte in the slice's bytes."""
    doc = words.doc_of()
    new = hit & ~np.concatenate([[False], hit[:-1] & (doc[1:] == doc[:-1])])[: len(hit)]
    end = hit & ~np.concatenate([hit[1:] & (doc[1:] == doc[:-1]), [False]])[: len(hit)]
    return doc[new], words.starts[new], words.ends[end]


def load_blocks(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> list:
    """The benchmark as broadcast blocks; the driver holds one block at a time."""
    out, items, n = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        h = T.words_of(pa.array([r.t]), T.ALNUM_WORDS).hashes()
        if len(h):
            items.append((r.i, h))
            n += max(1, len(h) - window + 1)
        if n >= block_windows:
            out.append(spark.sparkContext.broadcast(Phrases(items, window)))
            items, n = [], 0
    return [*out, spark.sparkContext.broadcast(Phrases(items, window))] if items else out


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of (doc_id, text): n_words, n_hit, items (the ids, sorted as strings) and removal spans (byte offsets in the UTF-8 text)."""
    blocks = load_blocks(spark, benchmark, window)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, max_bytes=SHARD):
            w = T.words_of(b.column("text"), T.ALNUM_WORDS)
            hit, items = find(w, blocks)
            count = np.concatenate([[0], np.cumsum(hit)])[w.first]
            spans: list[list] = [[] for _ in range(b.num_rows)]
            _, off = T.bytes_of(b.column("text"))
            for d, s, e in zip(*(x.tolist() for x in spans_of(w, hit)), strict=True):
                spans[d].append({"start": s - int(off[d]), "end": e - int(off[d])})
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(np.diff(count), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, span)],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_hit long, items array<string>, spans array<struct<start:bigint,end:bigint>>")


def remove_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``; other rows and columns stay as they are. A null text stays null."""
    blocks = load_blocks(spark, benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, max_bytes=SHARD):
            col = b.column("text")
            w = T.words_of(col, T.ALNUM_WORDS)
            hit, _ = find(w, blocks)
            if hit.any():
                data, off = T.bytes_of(col)
                cut: dict[int, list] = {}
                for d, s, e in zip(*(x.tolist() for x in spans_of(w, hit)), strict=True):
                    cut.setdefault(d, []).append((s, e))
                texts = col.to_pylist()
                for d, ranges in cut.items():
                    at, kept = int(off[d]), []
                    for s, e in ranges:
                        kept.append(data[at:s].tobytes())
                        at = e
                    texts[d] = b"".join([*kept, data[at : int(off[d + 1])].tobytes()]).decode()
                at = b.schema.get_field_index("text")
                b = b.set_column(at, b.schema.field(at), pa.array(texts, col.type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(texts: list[str | None], benchmark: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same figures by plain loops, for tests."""
    import re

    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins: dict[tuple, set] = {}
    for i, t in benchmark:
        w = words(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[at : at + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, items = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for at in range(len(w) - k + 1):
                if (x := tuple(w[at : at + k])) in wins:
                    hit |= set(range(at, at + k))
                    items |= wins[x]
        out.append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()))
    return out
