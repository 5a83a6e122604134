"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words (runs without white space, A-Z lower-cased); it is removed if a line that comes earlier,
by (doc_id, hash of the text, line number), has a Jaccard similarity of at least num / den with it, wherever that line is
and whether or not it is removed itself. Blank lines stay.

Plan
1. ``lines_of``: each line's place and 128-bit hash, 40 bytes a line. Equal lines become one vertex, its first place;
   later copies are removed without any join of words. Vertices are numbered in the order of their places.
2. ``rarity``: words are counted in hashed counters, a table of bounded size that tasks get as one array of bytes.
3. ``prefixes``: a vertex's words in order, rarest first. Kept are its size, a bitmap of parities of its words, and
   the prefix: so many of the rarest words that two similar sets share one there. Words counted once are in one line
   only; they count as positions but are not dealt out.
4. ``earliest``: vertices that share two neighbouring words of their prefixes, and are of about the same size, are
   compared with the earliest of them. This settles copies with small changes, in groups of any size, at a few
   comparisons each. Copies mostly share several such pairs; of what shares just one, mostly by chance, a vertex is
   compared with the closest by its bitmap at most.
5. ``candidates``: what is not settled meets all earlier vertices that share a prefix word. Let i and j be the places
   of the first word that two similar sets share: the i + j words before it are not shared, so i + j is at most the
   number of words in which similar sets of these sizes differ, and the smaller place is at most half of that. So only
   words in the front half of a prefix meet all words of the others. Each row carries the bitmap of the words from
   there on. A difference flips one bit of it at most, so i + j and the bits in which two bitmaps differ are together a
   lower bound of the differences. It sorts out nearly all pairs before anything is written.
6. ``matching``: Jaccard of the words themselves. One earlier match is enough, so links are never enumerated.

Null and empty texts have no lines. A null doc_id comes after all others. Rows of one doc_id, or without one, that have
different texts have places of their own. Rows with the same doc_id, or both without one, and the same text can't be
told apart: they share places and don't remove each other's lines. Lines of any length are compared whole. An empty
table gives an empty table. doc_id must be a whole number or castable to one; other columns pass through whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, drop_path, id_key, materialize, text_hash, unused

NUM, DEN = 80, 100
#: Counters of words: a power of two near a sixteenth of the words, within these bounds.
FEWEST, MOST = 1 << 16, 1 << 22
#: Counters in one row while their table is put together.
PART = 1 << 12
#: Sets with more words than this have a bitmap of 128 bits, the others one of 64.
LARGE = 64
#: So many words before a word of a prefix are taken out of its bitmap and counted.
COUNTED = 8
#: Of the hashes of words and of pairs of words so many bits are shuffled.
SHORT = (1 << 40) - 1
#: So many of the vertices with a common pair are compared with all others of them.
SLOTS = 8
#: Kinds of sizes within a factor of two; only vertices of one kind meet by a pair of words.
KINDS = 3
OTHER_SPACE = "\t\x0b\x0c\r"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, to compare only: the UTF-8 bytes stand as characters of Latin-1.

    lower() then changes A-Z and the lead bytes C3 to DE, which become E3 to FE. A lead byte of two still differs from
    one of three or four, by the number of bytes that follow, so different texts stay different. translate() does the
    same for A-Z at many times the cost.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def plain(text: Column) -> Column:
    """Lower-cased, with one kind of white space within lines."""
    out = lowered(text)
    for c in OTHER_SPACE:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_in(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is made once, however often it is used above."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def lines_of(docs: DataFrame) -> DataFrame:
    """key, row, line, hi, lo of every line that isn't blank."""
    lines = docs.where(F.col("text").isNotNull()).select(id_key().alias("key"), text_hash().alias("row"), F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line", "raw"))
    return lines.where(F.trim("raw") != "").select("key", "row", "line", F.xxhash64("raw").alias("hi"), F.xxhash64(F.lit(7), F.col("raw")).alias("lo"))


def vertices(spark: SparkSession, index: DataFrame) -> DataFrame:
    """hi, lo, key, row, line and p of each different line at its first place; p grows with the place."""
    first = index.groupBy("hi", "lo").agg(F.min(F.struct("key", "row", "line")).alias("first")).select("hi", "lo", "first.*")
    return materialize(spark, first.orderBy("key", "row", "line").withColumn("p", F.monotonically_increasing_id()), "vertices")


def vertex_texts(docs: DataFrame, vertex: DataFrame) -> DataFrame:
    """p, bytes and raw, the line itself, of each vertex."""
    wanted = vertex.groupBy("key", "row").agg(F.collect_list(F.struct("line", "p")).alias("wanted"))
    texts = docs.where(F.col("text").isNotNull()).select(id_key().alias("key"), text_hash().alias("row"), "text").dropDuplicates(["key", "row"])
    both = once(texts.join(wanted, ["key", "row"]).select("wanted", "text"), "lines", F.split(plain(F.col("text")), "\n"))
    found = F.transform("wanted", lambda x: F.struct(x["p"].alias("p"), F.get("lines", x["line"]).alias("raw")))
    return both.select(F.explode(found).alias("x")).select("x.p", F.octet_length("x.raw").alias("bytes"), "x.raw")


def counters(words: int) -> int:
    return min(MOST, max(FEWEST, 1 << (max(1, words) // 16).bit_length()))


def bucket(word: Column, size: int) -> Column:
    return F.shiftrightunsigned(word, 20).bitwiseAND(F.lit(size - 1)).cast("int")


def table(seen: DataFrame, size: int, level: Column) -> DataFrame:
    """One row, scale: a byte for each of ``size`` counters, ``level`` of n, how many rows of ``seen`` have it as b."""
    none = seen.sparkSession.range(size).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    every = seen.select("b", F.lit(1).cast("long").alias("n")).union(none).groupBy("b").agg(F.sum("n").alias("n"))
    part = every.select(F.floor(F.col("b") / PART).alias("part"), F.struct("b", level.cast("byte").alias("x")).alias("y")).groupBy("part").agg(F.sort_array(F.collect_list("y"))["x"].alias("xs"))
    return part.agg(F.flatten(F.sort_array(F.collect_list(F.struct("part", "xs")))["xs"]).alias("scale"))


def rarity(texts: DataFrame, size: int) -> DataFrame:
    """One row, scale: on a logarithmic scale how often the words of each counter occur; 0 for once at most."""
    words = texts.select(F.explode(F.split("raw", " ")).alias("w")).where("w <> ''").select(bucket(F.xxhash64("w"), size).alias("b"))
    return table(words, size, F.when(F.col("n") > 1, F.least(F.lit(127), F.floor(F.log2("n") * 4))).otherwise(0))


def parities(words: Column) -> Column:
    """Bit k: whether an odd number of the words have hashes that end in k."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))))


def odd_half(word: Column) -> Column:
    return word.bitwiseAND(F.lit(64)) > 0


def prefixes(texts: DataFrame, scale: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """p, n, alone, bits, odd, neighbours, prefix of each vertex; bits, odd: the bitmap of its words but for those counted once; alone: how many words of its prefix, the first ones, no other line has; prefix: 40 bits of the others' hashes; neighbours: as many of pairs of them, with the kind of the set's size.

    A word stands here as its rarity in the highest byte and its hash below, so that plain numbers sort by rarity.
    """
    rank = lambda h: F.shiftleft(F.get("scale", bucket(h, size)).cast("long"), 56) + F.shiftrightunsigned(h, 8)
    hashed = once(texts, "hashes", F.transform(words_in(F.col("raw")), lambda w: F.xxhash64(w))).select("p", "hashes")
    # the optimizer puts the table in place of the column that names it, so no row ever holds it
    looked_up = hashed.withColumn("scale", scale.select("scale").scalar()).select("p", F.array_distinct(F.transform("hashes", rank)).alias("ranked"))
    ranked = once(looked_up, "words", F.col("ranked")).select("p", "words")
    n, zero = F.size("words"), F.lit(0).cast("long")
    length = n + F.floor(-n * num / den).cast("int") + 1
    cut = once(ranked, "front", F.slice(F.sort_array("words"), F.lit(1), length))
    # whose prefix no other line shares, meets nothing and needs no bitmap
    some = F.element_at("front", -1) >= 1 << 56
    known = F.filter("words", lambda w: w >= 1 << 56)
    bits = F.when(some, parities(known)).otherwise(zero)
    large = F.when(some & (n > LARGE), parities(F.filter(known, odd_half))).otherwise(zero)
    # near copies mostly have sizes of one kind, what shares a pair of words by chance has any size
    kind = F.floor(F.log2(n) * KINDS)
    front = once(cut.select("p", n.alias("n"), bits.alias("bits"), large.alias("odd"), kind.alias("kind"), "front"), "prefix", F.filter("front", lambda x: x >= (1 << 56)))
    # the first word of each level of rarity, levels being a factor of two apart, and the word after it
    level = lambda w: F.shiftright(w, 58)
    pair = lambda w, i: F.when((i == 0) | (level(w) != level(F.get("prefix", i - 1))), F.xxhash64(w, F.get("prefix", i + 1), "kind").bitwiseAND(F.lit(SHORT)))
    neighbours, short = F.array_compact(F.transform("prefix", pair)), F.transform("prefix", lambda w: w.bitwiseAND(F.lit(SHORT)))
    return front.select("p", "n", (F.size("front") - F.size("prefix")).alias("alone"), "bits", "odd", neighbours.alias("neighbours"), short.alias("prefix"))


def apart(na: Column, nb: Column, bits: Column, odd: Column) -> Column:
    """In how many words sets of such sizes differ at least, by the differences of their bitmaps.

    bits has the parities of words by 6 bits of their hashes. odd, of large sets, has those of the words whose next bit
    is set; with bits it makes twice as many parities.
    """
    return F.when((na > LARGE) & (nb > LARGE), F.bit_count(odd) + F.bit_count(bits.bitwiseXOR(odd))).otherwise(F.bit_count(bits))


def may_match(na: Column, nb: Column, different: Column, num: int, den: int) -> Column:
    """Whether sets of such sizes that differ in so many words can be similar."""
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (different * (num + den) <= (na + nb) * (den - num))


def earliest(sets: DataFrame, num: int, den: int) -> DataFrame:
    """b, a: vertices, and the earliest, of each of SLOTS, of those that share two neighbouring words of their prefixes with them.

    The words that set one copy apart from others are mostly rarer than those that all of a group have, so there is a
    pair for each level of rarity. Vertices that share one pair only have met by chance for the most part, and more of
    them do the larger the table: of these, a vertex keeps the one whose bitmap is the closest, as in a group of copies
    that differ much one of the earliest is near enough mostly, but not each. What isn't settled then, such as copies
    whose sizes are of two kinds, is left to ``candidates``.
    """
    rows = sets.select("p", F.posexplode("neighbours").alias("i", "key"))
    least = rows.groupBy("key", F.pmod(F.xxhash64("p"), F.lit(SLOTS)).alias("slot")).agg(F.min("p").alias("a")).drop("slot")
    met = rows.select("key", F.col("p").alias("b"), "i").join(least, "key").where("a < b").select("b", "a", "i")
    counted = met.repartition("b").groupBy("b", "a").agg(F.count("*").alias("shared"), F.min("i").alias("i"))
    # sizes and bitmaps come to the few that met, so that no row of a pair of words carries them
    of = lambda s: sets.select("p", "n", "alone", "bits", "odd").toDF(s, *(c + s for c in ("n", "alone", "bits", "odd")))
    both = counted.join(of("b"), "b").join(of("a"), "a")
    different = F.col("alonea") + F.col("aloneb") + apart(F.col("na"), F.col("nb"), F.col("bitsa").bitwiseXOR(F.col("bitsb")), F.col("odda").bitwiseXOR(F.col("oddb")))
    near = both.where(may_match(F.col("na"), F.col("nb"), different, num, den)).select("b", "a", "shared", "i", different.alias("different"))
    turn = F.row_number().over(Window.partitionBy("b").orderBy("different", F.desc("shared"), "i", "a"))
    return near.select("b", "a", "shared", turn.alias("turn")).where("shared > 1 or turn = 1").select("b", "a")


def candidates(sets: DataFrame, settled: DataFrame, num: int, den: int) -> DataFrame:
    """b, a: vertices that aren't settled, and the earlier ones they may match."""
    known = sets.join(settled.withColumn("known", F.lit(1)), "p", "left").select("p", "n", "alone", "bits", "odd", F.coalesce("known", F.lit(0)).alias("known"), "prefix")
    rows = known.select("p", "n", "alone", "bits", "odd", "known", "prefix", F.posexplode("prefix").alias("i", "word"))
    bits, odd, zero = F.col("bits"), F.col("odd"), F.lit(0).cast("long")
    for k in range(COUNTED):
        w = F.get("prefix", F.lit(k))
        bit = F.when(F.col("i") > k, F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))).otherwise(zero)
        bits = bits.bitwiseXOR(bit)
        odd = odd.bitwiseXOR(F.when((F.col("n") > LARGE) & odd_half(w), bit).otherwise(zero))
    place = F.col("alone") + F.col("i")
    front = place * (2 * num) <= F.col("n") * (den - num)
    # in one number, to shuffle less: 40 bits of the word's hash, and size, words counted, front and known
    x = F.shiftleft(F.col("n").cast("long"), 32) + 4 * (F.col("alone") + F.least("i", F.lit(COUNTED))) + 2 * front.cast("int") + F.col("known")
    packed = rows.select("p", bits.alias("bits"), odd.alias("odd"), "word", x.alias("x"))
    side = lambda df, s: df.select("word", *(F.col(c).alias(c + s) for c in ("p", "bits", "odd", "x")))
    n, i = lambda s: F.shiftright("x" + s, 32), lambda s: F.shiftright(F.col("x" + s).bitwiseAND(F.lit((1 << 32) - 1)), 2)
    k, f = lambda s: F.col("x" + s).bitwiseAND(F.lit(1)), lambda s: F.col("x" + s).bitwiseAND(F.lit(2)) > 0
    # a has the front word; two front words meet twice, once from either side. Tested here and not before, so that both
    # sides are the same rows and are shuffled once
    order = F.when(~f("a"), 1).when(F.col("pa") < F.col("pb"), k("b")).when((F.col("pa") > F.col("pb")) & ~f("b"), k("a")).otherwise(1) == 0
    different = i("a") + i("b") + apart(n("a"), n("b"), F.col("bitsa").bitwiseXOR(F.col("bitsb")), F.col("odda").bitwiseXOR(F.col("oddb")))
    met = side(packed, "a").join(side(packed, "b"), "word").where(order & may_match(n("a"), n("b"), different, num, den))
    return met.select(F.greatest("pa", "pb").alias("b"), F.least("pa", "pb").alias("a")).distinct()


def matching(spark: SparkSession, texts: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """p of the vertices b that have a pair whose words are similar."""
    pairs = materialize(spark, pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("p")).union(pairs.select("b")).distinct()
    # of the texts, only those that a counter of the wanted ones lets through are shuffled
    size = counters(16 * 16 * pairs.count())
    at = lambda c: bucket(F.xxhash64(c), size)
    sieve = materialize(spark, table(wanted.select(at("p").alias("b")), size, F.least("n", F.lit(1))), "sieve")
    passed = texts.select("p", "raw").where(F.get(sieve.select("scale").scalar(), at("p")) > 0)
    fetched = materialize(spark, passed.join(wanted, "p"), "sets")
    sets = fetched.select("p", F.array_distinct(words_in(F.col("raw"))).alias("w"))
    both = pairs.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    both = both.select("b", F.size(F.array_intersect("wa", "wb")).alias("o"), (F.size("wa") + F.size("wb")).alias("s"))
    found = materialize(spark, both.where(F.col("o") * den >= (F.col("s") - F.col("o")) * num).select(F.col("b").alias("p")).distinct(), "matched")
    for done in (pairs, sieve, fetched):
        drop_path(spark, done.table_path)
    return found


def later_lines(spark: SparkSession, docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """key, row, line of every line with an earlier match."""
    index = materialize(spark, lines_of(docs), "index")
    vertex = vertices(spark, index)
    texts = materialize(spark, vertex_texts(docs, vertex), "texts")
    size = counters((texts.agg(F.sum("bytes")).first()[0] or 0) // 8)
    scale = materialize(spark, rarity(texts, size), "scale")
    sets = materialize(spark, prefixes(texts, scale, size, num, den), "prefixes")
    settled = matching(spark, texts, earliest(sets, num, den), num, den)
    matched = settled.union(matching(spark, texts, candidates(sets, settled, num, den), num, den))
    known = vertex.join(matched.withColumn("hit", F.lit(True)), "p", "left").select("hi", "lo", F.struct("key", "row", "line").alias("first"), F.col("hit").isNotNull().alias("hit"))
    later = index.join(known, ["hi", "lo"]).where(F.col("hit") | (F.struct("key", "row", "line") > F.col("first")))
    later = materialize(spark, later.select("key", "row", "line").distinct(), "later")
    for done in (index, vertex, texts, scale, sets):
        drop_path(spark, done.table_path)
    return later


def with_kept(spark: SparkSession, docs: DataFrame, num: int = NUM, den: int = DEN) -> tuple[DataFrame, str]:
    """``docs`` with one more column, the sorted numbers of the lines to remove, or null; and that column's name."""
    key, row, gone = unused(docs, "key", "row", "gone")
    lines = later_lines(spark, docs, num, den).groupBy(F.col("key").alias(key), F.col("row").alias(row)).agg(F.array_sort(F.collect_list("line")).alias(gone))
    return docs.withColumn(key, id_key()).withColumn(row, text_hash()).join(lines, [key, row], "left").drop(key, row), gone


def kept_text(gone: str) -> Column:
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def remove_lines(spark: SparkSession, docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with the later matches cut out of ``text``; every row stays. A null text stays null."""
    found, gone = with_kept(spark, docs, num, den)
    return found.withColumn("text", kept_text(gone)).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, gone = with_kept(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))))
    return found.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce(kept_text(gone), F.lit("")), 256).alias("kept_sha256"))


def brute_texts(rows: list[tuple[int | None, str | None]], num: int = NUM, den: int = DEN) -> list[tuple]:
    """Per row how many lines it has and those that are left."""
    import xxhash

    places = [(NULL_ID if i is None else i, int.from_bytes(xxhash.xxh64((t or "").encode(), seed=42).digest(), signed=True)) for i, t in rows]
    lines = []
    for place, (_, t) in zip(places, rows, strict=True):
        for n, raw in enumerate((t or "").split("\n")):
            if s := frozenset("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw).encode().split()):
                lines.append(((*place, n), s))
    gone = {p for p, s in lines if any(q < p and den * len(s & r) >= num * len(s | r) for q, r in lines)}
    out = []
    for place, (_, t) in zip(places, rows, strict=True):
        parts = (t or "").split("\n")
        out.append((len(parts) if t else 0, [x for n, x in enumerate(parts) if (*place, n) not in gone]))
    return out


def brute_force(rows: list[tuple[int | None, str | None]], num: int = NUM, den: int = DEN) -> list[tuple]:
    import hashlib

    found = zip(rows, brute_texts(rows, num, den), strict=True)
    return [(i, n, max(n, 1) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()) for (i, _), (n, keep) in found]
