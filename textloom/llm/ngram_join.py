"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

The set of a document is its distinct word n-grams, as 64-bit hashes. The hash order is cut vertically into fragments,
each with a bounded number of n-grams: all documents' sets are cut by the same limits, and a task takes a fragment.

Candidates: a fragment counts, over all documents, the sets that hold each of its n-grams. That gives the global order,
rarest first. Two similar sets share an n-gram among the rarest (1 - threshold) part of each, their prefixes; n-grams
of one set alone can't be shared, so only sets with nearly all n-grams repeated elsewhere go on, with the few repeated
n-grams of their prefix. N-grams that many documents of a block hold (hot passages) are put last in the order without
a count and don't pass through a fragment; any order that is the same for all sets gives the same links.

Each set also has a bitmap of parities. It bounds from below in how many n-grams two sets differ, and so sorts out pairs
that share a passage, or lie just below the threshold, before they are written.

Verification: the sets of candidates are cut into FRAGMENTS parts of the order; for each pair the overlap is counted
separately in each part, and the parts are summed per pair.

No group is expanded into all its pairs. Sets that share a prefix n-gram are first paired with one centre of their
group, and verified links are contracted to components; this is done ROUNDS times at most, with other centres. Then only
pairs with a shared prefix n-gram whose members lie in different components remain, which are all tested. So a group of
n copies costs a few n tests, and no link between components is lost.

Null and empty texts have an empty set and link with nothing. Texts of fewer than n words have one n-gram, the whole
sequence. Copies with equal sets are one vertex (64-bit fingerprint of the set), so repeated rows and null ids need no
care: a row with a null doc_id takes part, and its component is the smallest id that isn't null, or null.
Long texts are taken whole; an empty table gives an empty table; doc_id must be castable to a whole number; other columns
stay out of the way, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .common import connected_components, drop_path, id_key, materialize, text_hash, unused

FRAGMENTS = 4
#: n-grams that a block of documents gathers, and that a fragment holds.
BLOCK = 3 << 19
GROUP = 1 << 20
#: An n-gram is hot if so many documents of a block hold it, and so large a part of them.
HOT_DOCS, HOT_PART, MAX_HOT = 32, 0.01, 1_000_000
#: Turns of comparing members with the centres of their groups, before all that is left is compared; the centres of a
#: group in a turn; those of them that a member is compared with.
ROUNDS, SLOTS, PICKS = 4, 8, 4
#: Sets with so many prefix n-grams that other components have carry them along in the last comparison.
FEW = 64
#: A set's bitmap has so many times 64 bits.
BITMAPS = 4
U1 = T.U(1)
MAPS = [f"m{c}" for c in range(BITMAPS)]


def ngram_sets(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, ascending, one document after another, and their limits."""
    w = T.words_of(b.column("text"))
    h = w.hashes()
    wins, _ = T.inner_windows(w.first, k)
    grams = T.window_hashes(h, k)[wins] if len(wins) else np.zeros(0, T.U)
    off = np.concatenate([[0], np.cumsum(np.maximum(w.counts - k + 1, 0))])
    sets = []
    for i, n in enumerate(w.counts.tolist()):
        if n >= k:
            sets.append(np.unique(grams[off[i] : off[i + 1]]))
        else:
            sets.append(T.window_hashes(h[w.first[i] : w.first[i + 1]], n) if n else grams[:0])
    return (np.concatenate(sets) if sets else grams), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def fingerprints(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each set; 0 for the empty set only."""
    c = np.zeros(len(grams) + 1, T.U)
    np.cumsum(T.mix(grams ^ T.U(0x5851F42D4C957F2D)), out=c[1:])
    fp = T.mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(T.U))
    return np.where(np.diff(off) > 0, np.where(fp == 0, T.U(1), fp), T.U(0))


def bitmaps(grams: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """BITMAPS 64-bit numbers of each set: of each low part of the hashes, whether an odd number of n-grams has it."""
    bit, part = U1 << (grams & T.U(63)), (grams >> T.U(6)) & T.U(BITMAPS - 1)
    some = np.flatnonzero(np.diff(off))
    out = []
    for c in range(BITMAPS):
        x = np.zeros(len(off) - 1, T.U)
        if len(some):
            x[some] = np.bitwise_xor.reduceat(np.where(part == T.U(c), bit, T.U(0)), off[some])
        out.append(x.view(np.int64))
    return out


def near(a: str, b: str, na: Column, nb: Column, num: int, den: int) -> Column:
    """Whether the bitmaps, columns of these names with 0, 1 ... after them, let sets of such sizes be similar.

    Every n-gram that only one of the sets has changes one bit at most, so they differ in as many n-grams as bits at least.
    """
    bits: Column = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in range(BITMAPS)), F.lit(0))
    return bits * (num + den) <= (na + nb) * (den - num)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Per document doc_id, n, fp, row (hash of its text), m0, m1 ... (its bitmap); and hot n-grams of blocks (hot true): fp the n-gram, n the block's documents with it."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen, names, idtype = [], 0, set(), ["doc_id", "n", "fp", "hot", "row", *MAPS], None

        def hot() -> Iterator[pa.RecordBatch]:
            grams = np.sort(np.concatenate(held))
            at, many = T.runs(grams)
            some = many >= max(HOT_DOCS, HOT_PART * len(seen))
            yield pa.RecordBatch.from_arrays([pa.nulls(int(some.sum()), idtype), pa.array(many[some], pa.int64()), pa.array(grams[at[some]].view(np.int64)), pa.array(np.ones(some.sum(), bool)), *(pa.nulls(int(some.sum()), pa.int64()) for _ in ("row", *MAPS))], names=names)

        for b in T.slices(batches):
            idtype = b.column("doc_id").type
            grams, off = ngram_sets(b, k)
            fp = fingerprints(grams, off)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(off)), pa.array(fp.view(np.int64)), pa.array(np.zeros(b.num_rows, bool)), b.column("row"), *map(pa.array, bitmaps(grams, off))], names=names)
            new = [i for i, x in enumerate(fp.tolist()) if x and not (x in seen or seen.add(x))]
            held += [grams[off[i] : off[i + 1]] for i in new]
            n += sum(len(x) for x in held[len(held) - len(new) :])
            if n >= BLOCK:
                yield from hot()
                held, n, seen = [], 0, set()
        if n:
            yield from hot()

    return docs.select("doc_id", "text", text_hash().alias("row")).mapInArrow(run, f"doc_id {kind}, n long, fp long, hot boolean, row long, " + ", ".join(f"{m} long" for m in MAPS))


def fragments_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal cuts of the global order an n-gram lies in."""
    return (((h >> T.U(32)) * T.U(parts)) >> T.U(32)).astype(np.int64)


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of two similar sets, both have an n-gram of the other among so many of their rarest."""
    return n + (-n * num) // den + 1


def prefixes(spark: SparkSession, docs: DataFrame, k: int, num: int, den: int, hot: np.ndarray, groups: int, buckets: int) -> DataFrame:
    """sig, node, n, most: the n-grams of each vertex's prefix that another vertex may hold; the vertex shares ``most`` n-grams with others, by the greatest of its rows."""
    shared = spark.sparkContext.broadcast(hot)
    names3 = ["gid", "keys", "nodes"]

    def rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 200], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names3)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, direct, total, seen = [], [], 0, {}

        def flush() -> Iterator[pa.RecordBatch]:
            key, node = (np.concatenate(x) for x in zip(*held, strict=True))
            names = np.fromiter(seen, T.U, len(seen))
            info = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            by = np.argsort(key)
            key, node = key[by], node[by]
            at, many = T.runs(fragments_of(key, groups))
            out = []
            for g, a, m in zip(fragments_of(key[at], groups).tolist(), at.tolist(), many.tolist(), strict=True):
                mine, index = np.unique(node[a : a + m], return_inverse=True)
                body = names[mine].tobytes() + info[mine].tobytes() + index.astype("<u2" if len(mine) < 1 << 16 else "<u4").tobytes()
                out.append((g, T.pack_sorted(key[a : a + m]), body + len(mine).to_bytes(8, "little")))
            if direct:
                sig, d = np.concatenate([x for x, _ in direct]), np.concatenate([y for _, y in direct])
                out.append((-1 - int(sig[0] % T.U(997)), sig.tobytes(), names[d].tobytes() + info[d].tobytes()))
            yield from rows_of(out)

        for b in T.slices(batches):
            grams, off = ngram_sets(b, k)
            fp = fingerprints(grams, off)
            size, keep = np.diff(off), []
            base = len(seen)
            warm = np.zeros(len(grams), bool)
            if len(shared.value):
                warm = shared.value[np.minimum(np.searchsorted(shared.value, grams), len(shared.value) - 1)] == grams
            warm_n = np.concatenate([[0], np.cumsum(warm)])[off]
            for i, x in enumerate(fp.tolist()):
                if x and x not in seen:
                    seen[x] = (int(size[i]), int(warm_n[i + 1] - warm_n[i]))
                    keep.append(i)
            if not keep:
                continue
            which = np.full(len(fp), -1, np.int64)
            which[keep] = base + np.arange(len(keep))
            doc = np.repeat(which, size)
            cold = ~warm & (doc >= 0)
            held.append((grams[cold], doc[cold]))
            # a prefix reaches the hot n-grams, the last of the order, if the others are fewer than it is long
            n, w = size[keep], np.diff(warm_n)[keep]
            more = prefix_size(n, num, den) - (n - w)
            for i, m in zip(np.array(keep)[more > 0].tolist(), more[more > 0].tolist(), strict=True):
                mine = grams[off[i] : off[i + 1]][warm[off[i] : off[i + 1]]][:m]
                direct.append((mine, np.full(len(mine), which[i])))
            total += int(size[keep].sum())
            if total >= BLOCK:
                yield from flush()
                held, direct, total, seen = [], [], 0, {}
        if held:
            yield from flush()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        """Counts the vertices of each n-gram of a fragment and sends those of two or more to their vertices' buckets."""
        if key[0].as_py() < 0:
            return table.select(names3)
        grams, nodes, infos = [], [], []
        for g, d in zip(table.column("keys").to_pylist(), table.column("nodes").to_pylist(), strict=True):
            n = int.from_bytes(d[-8:], "little")
            index = np.frombuffer(d[24 * n : -8], "<u2" if n < 1 << 16 else "<u4")
            grams.append(T.unpack_sorted(g))
            nodes.append(np.frombuffer(d[: 8 * n], T.U)[index])
            infos.append(np.frombuffer(d[8 * n : 24 * n], np.int64).reshape(-1, 2)[index].astype(np.int32))
        gram, node, info = np.concatenate(grams), np.concatenate(nodes), np.concatenate(infos)
        by = np.lexsort((node, gram))
        gram, node = gram[by], node[by]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
        gram, node, info = gram[new], node[new], info[by[new]]
        at, many = T.runs(gram)
        count = np.repeat(many, many)
        some = count > 1
        gram, node, info, count = gram[some], node[some], info[some], np.minimum(count[some], 65535)
        bucket = (node % T.U(buckets)).astype(np.int64)
        by = np.lexsort((node, bucket))
        gram, node, info, count, bucket = gram[by], node[by], info[by], count[by], bucket[by]
        out = []
        for a, m in zip(*(x.tolist() for x in T.runs(bucket)), strict=True):
            part = slice(a, a + m)
            first, times = T.runs(node[part])
            head = node[part][first].tobytes() + info[part][first].tobytes() + times.astype("<i4").tobytes()
            out.append((int(bucket[a]), gram[part].tobytes() + count[part].astype("<u2").tobytes(), head + len(first).to_bytes(8, "little")))
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names3, (pa.int64(), pa.binary(), pa.binary()), strict=True))})

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        """Puts the n-grams of each vertex in order, rarest first, and keeps those of the prefix."""
        sigs, nodes, sizes, warm, counts = [], [], [], [], []
        for g, d in zip(table.column("keys").to_pylist(), table.column("nodes").to_pylist(), strict=True):
            if key[0].as_py() < 0:
                n = len(g) // 8
                sigs.append(np.frombuffer(g, T.U))
                nodes.append(np.frombuffer(d[: 8 * n], T.U))
                info = np.frombuffer(d[8 * n :], np.int64).reshape(-1, 2)
                sizes.append(info[:, 0])
                warm.append(info[:, 1])
                continue
            n, m = int.from_bytes(d[-8:], "little"), len(g) // 10
            info = np.frombuffer(d[8 * n : 16 * n], np.int32).reshape(-1, 2)
            times = np.frombuffer(d[16 * n : 20 * n], "<i4")
            sigs.append(np.frombuffer(g[: 8 * m], T.U))
            counts.append(np.frombuffer(g[8 * m :], "<u2"))
            nodes.append(np.repeat(np.frombuffer(d[: 8 * n], T.U), times))
            sizes.append(np.repeat(info[:, 0], times))
            warm.append(np.repeat(info[:, 1], times))
        sig, node, n, w = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(sizes).astype(np.int64), np.concatenate(warm).astype(np.int64)
        most = w
        if key[0].as_py() >= 0:
            by = np.lexsort((sig, np.concatenate(counts), node))
            sig, node, n, w = sig[by], node[by], n[by], w[by]
            at, many = T.runs(node)
            rank = np.arange(len(node)) - np.repeat(at, many)
            alone = n - w - np.repeat(many, many)
            keep = rank < prefix_size(n, num, den) - alone
            sig, node, n, most = sig[keep], node[keep], n[keep], (n - alone)[keep]
        return pa.table({"sig": pa.array(sig.view(np.int64)), "node": pa.array(node.view(np.int64)), "n": pa.array(n), "most": pa.array(most)})

    three = "gid long, keys binary, nodes binary"
    dealt = docs.select("text").mapInArrow(deal, three)
    return dealt.groupBy("gid").applyInArrow(meet, three).groupBy("gid").applyInArrow(cut, "sig long, node long, n long, most long")


def segments(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, frag, n, grams: the sets of the wanted vertices (columns key, node), cut into FRAGMENTS parts of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            grams, off = ngram_sets(b, k)
            fp, want = fingerprints(grams, off).view(np.int64), b.column("node").to_numpy()
            cut = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], T.U)
            rows = []
            for i in np.flatnonzero(fp == want).tolist():
                g = grams[off[i] : off[i + 1]]
                limits = [0, *np.searchsorted(g, cut).tolist(), len(g)]
                rows += [(int(fp[i]), f, len(g), T.pack_sorted(g[limits[f] : limits[f + 1]])) for f in range(FRAGMENTS)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["node", "frag", "n", "grams"])

    keyed = docs.select(id_key().alias("key"), "text")
    return keyed.join(wanted, "key").select("node", "text").mapInArrow(run, "node long, frag int, n long, grams binary")


def verified(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, and what else they have) whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("ga").to_pylist(), b.column("gb").to_pylist()
            both = [len(np.intersect1d(T.unpack_sorted(p), T.unpack_sorted(q), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "frag", "na", "nb")), pa.array(both, pa.int64())], names=[*keep, "frag", "na", "nb", "both"])

    keep = pairs.columns
    joined = pairs.join(parts.toDF("b", "frag", "nb", "gb"), "b").join(parts.toDF("a", "frag", "na", "ga"), ["a", "frag"])
    kinds = ", ".join(f"{c} {k}" for c, k in pairs.dtypes)
    partial = joined.select(*keep, "frag", "na", "nb", "ga", "gb").mapInArrow(run, f"{kinds}, frag int, na long, nb long, both long")
    # max before the sum: a set that came in twice counts once
    summed = partial.groupBy(*keep, "na", "nb").agg(*(F.max(F.when(F.col("frag") == f, F.col("both"))).alias(f"o{f}") for f in range(FRAGMENTS)))
    overlap: Column = sum((F.coalesce(F.col(f"o{f}"), F.lit(0)) for f in range(FRAGMENTS)), F.lit(0))
    return summed.where(den * overlap >= num * (F.col("na") + F.col("nb") - overlap)).select(*keep)


def can_reach(n1: str, n2: str, most1: str, most2: str, num: int, den: int) -> Column:
    """Whether sets of these sizes are similar if they share as many n-grams as each shares with any set at all."""
    both = F.least(most1, most2, n1, n2)
    return den * both >= num * (F.col(n1) + F.col(n2) - both)


def vertices(spark: SparkSession, docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, row, n, fp); members (sig, node, n, centre, most, bitmap) of the groups that share a prefix n-gram; the members' sets in parts."""
    described = materialize(spark, describe(docs, shingle), "sets")
    meta = described.where("not hot").select("doc_id", "row", "n", "fp")
    hot_rows = described.where("hot").groupBy("fp").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "fp").limit(MAX_HOT).collect()
    hot = np.sort(np.array([r.fp for r in hot_rows], np.int64).view(T.U))
    total = meta.agg(F.sum("n")).first()[0] or 0
    groups = max(8, total // GROUP)
    prefix = materialize(spark, prefixes(spark, docs, shingle, num, den, hot, groups, max(8, groups // 8)), "prefixes")
    centres = prefix.groupBy("sig").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").select("sig", "centre")
    most = prefix.groupBy("node").agg(F.max("most").alias("most"))
    maps = described.where("not hot and n > 0").groupBy(F.col("fp").alias("node")).agg(*(F.min(m).alias(m) for m in MAPS))
    members = materialize(spark, prefix.drop("most").distinct().join(centres, "sig").join(most, "node").join(maps, "node"), "buckets")
    drop_path(spark, prefix.table_path)
    wanted = members.select("node").union(members.select("centre")).distinct()
    holders = meta.where("n > 0").groupBy(F.col("fp").alias("node")).agg(F.min(id_key()).alias("key"))
    return meta, members, materialize(spark, segments(docs, holders.join(wanted, "node"), shingle), "segments")


def with_components(spark: SparkSession, members: DataFrame, label: DataFrame | None) -> DataFrame:
    """The members with comp, the component of their node as far as it is known."""
    if label is None:
        placed = members.withColumn("comp", F.col("node"))
    else:
        placed = members.join(label.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return materialize(spark, placed.select("sig", "node", "n", "most", *MAPS, "comp"), "placed")


def star_pairs(placed: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """a, b: members, each with centres of the groups that it is in and that hold other components too.

    A group has one centre in the first turn, when hardly any member is linked yet, and SLOTS others in each later one. A
    member goes with the centre that it shares most groups with, later with the PICKS of them.
    """
    slots, picks = (SLOTS, PICKS) if turn else (1, 1)
    carried = ["node", "n", "most", "comp", *MAPS]
    drawn = F.xxhash64("node", F.lit(turn))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
    placed = placed.join(mixed, "sig")
    centre = placed.groupBy("sig", F.pmod(drawn, F.lit(slots)).alias("slot")).agg(*(F.min_by(c, drawn).alias("c_" + c) for c in carried)).drop("slot")
    close = can_reach("n", "c_n", "most", "c_most", num, den) & near("m", "c_m", F.col("n"), F.col("c_n"), num, den)
    met = placed.join(centre, "sig").where((F.col("comp") != F.col("c_comp")) & close).groupBy("node", "c_node").agg(F.count("*").alias("count"))
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "c_node")))
    return best.where(F.col("place") <= picks).select(F.col("c_node").alias("a"), F.col("node").alias("b"))


def labelled(spark: SparkSession, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles and component_id of every row of ``docs``."""
    meta, members, parts = vertices(spark, docs, shingle, num, den)
    label, tested, links = None, [], []
    for turn in range(ROUNDS):
        placed = with_components(spark, members, label)
        pairs = materialize(spark, star_pairs(placed, turn, num, den), "pairs")
        found = materialize(spark, verified(pairs, parts, num, den), "links")
        tested.append(pairs)
        drop_path(spark, placed.table_path)
        if turn and found.isEmpty():
            drop_path(spark, found.table_path)
            break
        links.append(found)
        label = connected_components(spark, reduce(DataFrame.union, links))
    placed = with_components(spark, members, label)
    per = placed.groupBy("sig", "comp").count().groupBy("sig").agg(F.max(F.struct("count", "comp")).alias("most"), F.count("*").alias("comps"))
    shared = materialize(spark, placed.join(per.where("comps > 1").select("sig", F.col("most.comp").alias("major")), "sig"), "shared")
    few = shared.groupBy("node").agg(F.collect_list("sig").alias("sigs")).select("node", F.when(F.size("sigs") <= FEW, F.col("sigs")).alias("sigs"))
    mixed = shared.join(few, "node")
    x, y = (mixed.select("sig", "major", F.col("node").alias(s), *(F.col(c).alias(d + s) for c, d in (("n", "n"), ("most", "m"), ("comp", "c"), ("sigs", "s"))), *(F.col(m).alias(s + m) for m in MAPS)) for s in "xy")
    # of what two sets share, all up to where the first of their prefixes ends meets here; the rest lies after a prefix
    after = F.greatest(*(-F.floor(-F.col(n) * num / den) - 1 for n in ("nx", "ny"))).cast("long")
    enough = lambda met: den * (met + after) >= num * (F.col("nx") + F.col("ny") - met - after)
    # sets with few n-grams here carry them, so that a pair counts them at once and meets but once, at the least of them
    common = F.array_intersect("sx", "sy")
    once = F.when(F.col("sx").isNull() | F.col("sy").isNull(), True).otherwise((F.array_min(common) == F.col("sig")) & enough(F.size(common)))
    close = can_reach("nx", "ny", "mx", "my", num, den) & near("xm", "ym", F.col("nx"), F.col("ny"), num, den)
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("major")) | (F.col("x") < F.col("y")))
    across = x.where("cx <> major").drop("major").join(y, "sig").where(apart & close & once).withColumn("met", F.when(F.col("sx").isNull() | F.col("sy").isNull(), 1).otherwise(F.size(common)))
    swap = F.col("x") < F.col("y")
    sides = (("x", "y", "a"), ("y", "x", "b"), ("cx", "cy", "ca"), ("cy", "cx", "cb"))
    across = across.groupBy("nx", "ny", *(F.when(swap, F.col(p)).otherwise(F.col(q)).alias(name) for p, q, name in sides)).agg(F.sum("met").alias("met"))
    across = across.where(enough(F.col("met"))).select("a", "b", "ca", "cb").distinct()
    done = reduce(DataFrame.union, tested).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = materialize(spark, across.join(done, ["a", "b"], "left_anti"), "pairs")
    joins = connected_components(spark, verified(second, parts, num, den).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    for old in (members, placed, second, parts, shared, *tested, *links):
        drop_path(spark, old.table_path)

    label = label.toDF("fp", "c1")
    joined = meta.join(label, "fp", "left").withColumn("c1", F.coalesce("c1", "fp")).join(joins.toDF("c1", "c2"), "c1", "left")
    comp = joined.select("doc_id", "row", "n", F.coalesce("c2", "c1").alias("comp"))
    least = comp.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return comp.join(least, "comp", "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_components(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return labelled(spark, docs, shingle, num, den).drop("row")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component. Rows without words, and rows whose component has no id, stay.

    Each row is judged by its own text: others of its doc_id, or others without one, may go while it stays.
    """
    found = labelled(spark, docs, shingle, num, den)
    gone = found.where("n_shingles > 0 and component_id is not null and (doc_id is null or doc_id <> component_id)")
    key, row = unused(docs, "key", "row")
    keyed = docs.withColumn(key, id_key()).withColumn(row, text_hash())
    return keyed.join(gone.select(id_key().alias(key), F.col("row").alias(row)).distinct(), [key, row], "left_anti").select(*docs.columns)


def link_counts(spark: SparkSession, docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and n_links of every row of ``docs``: how many other rows have a similar set.

    Unlike the components, this tests every pair of different sets that share a prefix n-gram, in a group of n near copies n² / 2.
    """
    meta, members, parts = vertices(spark, docs, shingle, num, den)
    a, b = (members.select("sig", *(F.col(c).alias(f"{c}{x}") for c in ("node", "n", "most")), *(F.col(m).alias(x + m) for m in MAPS)) for x in "ab")
    both = can_reach("na", "nb", "mosta", "mostb", num, den) & near("am", "bm", F.col("na"), F.col("nb"), num, den)
    pairs = a.join(b, "sig").where((F.col("nodea") < F.col("nodeb")) & both).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()
    pairs = materialize(spark, pairs, "pairs")
    links = materialize(spark, verified(pairs, parts, num, den), "links")
    copies = meta.where("n > 0").groupBy("fp").agg(F.count("*").alias("copies"))
    two_ways = links.select("a", "b").union(links.select("b", "a")).toDF("fp", "other")
    others = two_ways.join(copies.toDF("other", "rows"), "other").groupBy("fp").agg(F.sum("rows").alias("near"))
    counts = copies.join(others, "fp", "left").select("fp", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    for done in (members, parts, pairs):
        drop_path(spark, done.table_path)
    return meta.join(counts, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)


def brute_force(rows: list[tuple[int | None, str | None]], shingle: int = 5, num: int = 80, den: int = 100) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    comp = list(range(len(rows)))

    def root(i: int) -> int:
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                comp[root(i)] = root(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
