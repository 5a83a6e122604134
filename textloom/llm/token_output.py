"""Token ids in ORC files: encode, write in ascending doc_id order, read back by stripes.

Texts are dealt out by ranges of doc_id, sorted, encoded, and written with row indexes, a Bloom filter on doc_id and
integer run-length encoding (ORC's for int columns); files are in the order of their partition numbers. Stored is
``start`` within a task, and the tasks' totals give the rest, so reading needs no sort and no window over all rows.

Encoding is by white-space-separated chunks: the tokenizer never joins ids across white space, so a chunk that comes
again costs a lookup. Each worker keeps a bounded table of chunks. New ones are encoded many in one text, which costs the
tokenizer about two thirds; a character that is one id by itself separates them. If the tokenizer lower-cases, chunks that
differ in the case of A-Z only are one, unless a mark that may compose with a letter or a special token is near.

A null text counts as empty and gives the end id alone. Rows with a null doc_id come first. Rows with the same doc_id
are ordered by text, so repeated rows follow each other. Long texts are encoded whole; an empty table gives an empty
table; columns beside doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import CLEANUP, materialize, new_path, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Chunks a worker remembers before it begins anew, places of its table (a power of two), and chunks encoded in one text.
CACHE, PLACES, JOINED = 1_500_000, 1 << 22, 100
#: Stands between chunks that are encoded together.
BREAK = "\x01"
#: Lead bytes of the marks U+0300 to U+037F. Some compose with a small letter and not with its capital.
MARKS = (0xCC, 0xCD)


class ChunkEncoder:
    """Ids of chunks, in one pool; entry 0 is the end id alone.

    A chunk's entry is at the place that the first bits of its hash say. One that another has pushed out is encoded again.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        capitals, normalizer = bytes(range(0x41, 0x5B)).decode(), self.tok.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str(capitals) == capitals.lower()
        self.special = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        between = self.tok.encode(f"a {BREAK} a {BREAK}", add_special_tokens=False).ids
        alone = self.tok.encode(BREAK, add_special_tokens=False).ids
        self.break_id = alone[0] if len(alone) == 1 and between.count(alone[0]) == 2 else None
        self.reset()

    def reset(self) -> None:
        self.place, self.hash = np.zeros(PLACES, np.int32), np.zeros(1, np.uint64)
        self.pool = np.array([self.end_id], np.int32)
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def one_case(self, col: pa.Array) -> bool:
        """Whether the texts give the same ids with A-Z lower-cased."""
        if not self.lowers:
            return False
        data = T.bytes_of(col)[0]
        if any((data == m).any() for m in MARKS):
            return False
        low = T.LOWER[data].tobytes()
        return not any(x in low for x in self.special)

    def ids_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks and how many each has."""
        encode = lambda texts: [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)] if self.break_id is not None else []
        out, size = [], []
        for group, found in zip(groups, encode([f" {BREAK} ".join(g) for g in groups]), strict=True):
            ids = np.array(found, np.int32)
            at = np.flatnonzero(ids == self.break_id)
            if len(at) == len(group) - 1:
                out.append(np.delete(ids, at))
                size.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
            else:  # a chunk holds that character
                alone = encode(group)
                out.append(np.array([i for x in alone for i in x], np.int32))
                size.append(np.array([len(x) for x in alone], np.int64))
        if not groups:
            alone = encode(chunks)
            out, size = [np.array([i for x in alone for i in x], np.int32)], [np.array([len(x) for x in alone], np.int64)]
        return np.concatenate(out), np.concatenate(size)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their end ids, and the texts' limits."""
        w = T.words_of(col, lower=self.one_case(col))
        if len(self.size) > CACHE:
            self.reset()
        hashes = w.hashes()
        place = (hashes >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
        entry = self.place[place].astype(np.int64)
        new = np.flatnonzero((entry == 0) | (self.hash[entry] != hashes))
        if len(new):
            uniq, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            data, s, e = w.data.tobytes(), w.starts[new[first]].tolist(), w.ends[new[first]].tolist()
            more, size = self.ids_of([data[a:b].decode() for a, b in zip(s, e, strict=True)])
            found = np.arange(len(self.size), len(self.size) + len(uniq))
            entry[new] = found[inverse]
            self.place[place[new[first]]] = found
            self.hash = np.append(self.hash, uniq)
            self.start = np.append(self.start, len(self.pool) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.pool = np.append(self.pool, more)
        docs = len(w.first) - 1
        seq = np.zeros(len(entry) + docs, np.int64)
        seq[np.arange(len(entry)) + w.doc_of()] = entry
        size = self.size[seq]
        end = np.cumsum(size)
        at = np.repeat(self.start[seq] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        limits = np.concatenate([[0], end])[np.concatenate([[0], w.first[1:] + np.arange(1, docs + 1)])]
        return self.pool[at], limits


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int) -> ChunkEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = ChunkEncoder(path, end_id)
    return _encoders[path, end_id]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes doc_id, start (ids before the document in its file) and ids to ORC files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(tokenizer, end_id), 0
        for b in T.slices(batches, max_bytes=2 << 20):
            ids, limits = enc.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(before + limits[:-1]), pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(ids))], names=["doc_id", "start", "ids"])
            before += int(limits[-1])

    kind = dict(docs.dtypes)["doc_id"]
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(run, f"doc_id {kind}, start long, ids array<int>").write
    writer.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(32 << 20)).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at = ids.offsets.to_numpy()
            raw = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(raw[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file"), b.column("start"), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "file", "start", "n_tokens", "ids_crc32"])

    table = spark.read.schema(f"doc_id {doc_id_type}, start long, ids array<int>").orc(path)
    read = table.select("doc_id", F.col("_metadata.file_name").alias("file"), "start", "ids").mapInArrow(run, f"doc_id {doc_id_type}, file string, start long, n_tokens long, ids_crc32 long")
    rows = materialize(spark, read, "tokens")
    # a task's files share its partition number and its running start, however many it wrote
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    totals = rows.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("total"))  # a row for each task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    joined = rows.withColumn("part", part).join(bases, "part")
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_path(spark, "token_ids")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        write_tokens(docs, path, tokenizer_path(TOKENIZER))
    finally:
        spark.conf.set(CLEANUP, before)
    return read_tokens(spark, path, dict(docs.dtypes)["doc_id"])


def brute_force(rows: list[tuple[int, str | None]], tokenizer: str, end_id: int = END_ID) -> list[tuple]:
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
