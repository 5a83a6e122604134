"""The screens against plain Python, on texts of every awkward kind, and what their plans shuffle."""

import random
import sys

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from textloom.functions import text as T
from textloom.operators import collision as C
from textloom.operators import references as R

SF = "/root/testdata/sf0.001"


def texts():
    rnd = random.Random(5)
    words = "the of and alpha beta gamma delta x yz 25 a1 über naïve éa ｆｕｌｌ K İx".split()
    some = [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(60)]
    odd = [None, "", " .,;", "a", "ab", "abcd", "abcde", "the of and", "the", "a" * 30, "a" * 31, "x" * 19, "x" * 20, "x" * 21, "aa " * 500]
    return odd + some + [some[0], some[1] + " and more", some[2][3:], "!" + some[3].upper() + "?"], [*odd[2:], *some[:20], "zz " + some[30] + " zz", some[31][2:-2], some[0]]


def brute(left, right, variant, similar=True):
    def sides(rows):
        out = []
        for i, t in rows:
            if n := R.normalized(t).decode():
                kept = [w for w in n.split() if w not in T.STOPWORDS]
                s = "".join(kept if variant == "all_filtered" else n.split())
                out.append((i, n, set(n.split() if variant == "base" else kept), {s[k : k + 5] for k in range(max(1, len(s) - 4))} if s else set()))
        return out

    found, top = [], {}
    for i, a, aw, ag in sides(left):
        for j, b, bw, bg in sides(right):
            if a == b:
                found.append((i, R.KINDS[0], j, None))
            elif min(len(a), len(b)) >= 20 and (a in b or b in a):
                found.append((i, R.KINDS[1], j, None))
            for k, x, y, least in ((2, aw, bw, 0.15), (3, ag, bg, 0.1)):
                s = len(x & y) / max(1, len(x | y))
                if similar and s >= least:
                    found.append((i, R.KINDS[k], j, round(s, 6)))
                top.setdefault((i, k), []).append((s, j))
    return found, top


def plain(rows):
    return sorted([(r[0], r[1], r[2], None if r[3] is None else round(r[3], 6)) for r in rows], key=str)


@pytest.mark.parametrize("chunk, group, block", [(1 << 21, 1 << 21, 1 << 21), (64, 50, 300), (7, 1, 1)])
@pytest.mark.parametrize("variant", ["base", "tokens_filtered", "all_filtered"])
def test_index_by_any_pieces(monkeypatch, variant, chunk, group, block):
    monkeypatch.setattr(R, "CHUNK", chunk)
    monkeypatch.setattr(R, "GROUP", group)
    monkeypatch.setattr(R, "BLOCK", block)
    left, right = (list(enumerate(x)) for x in texts())
    batches = pa.Table.from_pylist([{"id": i, "text": t} for i, t in left]).to_batches()
    for similar in (True, False):
        got = [tuple(r.values()) for refs in R.blocks(right, pa.int64(), True, variant, similar) for b in R.collisions(refs, batches, True) for r in b.to_pylist()]
        assert plain(got) == plain(brute(left, right, variant, similar)[0])


def test_normalized_like_the_expression(spark):
    from pyspark.sql import functions as F

    rows = ["".join(f"b{chr(c)}a" for c in range(at, min(at + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000) for at in range(0, sys.maxunicode + 1, 4096)]
    for nfkc in (True, False):
        got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.normalize(F.col("t"), nfkc).alias("n")).collect()
        assert [r.n for r in got] == [R.normalized(r.t, nfkc).decode() for r in got]


@pytest.mark.parametrize("variant", ["base", "tokens_filtered", "all_filtered"])
def test_screen_of_any_ids(spark, monkeypatch, variant):
    monkeypatch.setattr(R, "BLOCK", 1000)  # several blocks
    a, b = texts()
    left, right = [*((f"d{i}", t) for i, t in enumerate(a)), (None, a[20])], [(f"r{i}", t) for i, t in enumerate(b)]
    frames = [spark.createDataFrame(x, "id string, text string") for x in (left, right)]
    assert plain(C.screen(*frames, variant=variant).collect()) == plain(brute(left, right, variant)[0])
    assert C.screen(frames[0], frames[1].limit(0)).collect() == C.screen(frames[0].limit(0), frames[1]).collect() == []


def operators(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, scans", [("collision_screen", 1), ("containment_gate", 2), ("sampling_screen", 1), ("screen_all_filtered", 1), ("screen_tokens_filtered", 1), ("selection_screen", 1)])
def test_no_grams_are_shuffled(spark, name, scans):
    plan = operators(entry.queries()[name](spark, SF))
    assert "Generate" not in plan and plan.count("MapInArrow") == plan.count("Scan parquet") == scans
    assert "Join" not in plan or name == "containment_gate"  # of the pairs found
    assert "Exchange" not in plan or name not in ("collision_screen", "screen_all_filtered", "screen_tokens_filtered")


def test_review_ends_pairs_that_are_fatal(spark):
    a, b = texts()
    frames = [spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (a, b)]
    want = brute(enumerate(a), list(enumerate(b)), "base")[0]
    ended = {(i, j) for i, k, j, _ in want if k in C.FATAL}
    got = C.review(C.screen(*frames)).collect()
    assert plain(got) == plain([x for x in want if x[1] in C.FATAL or (x[0], x[2]) not in ended]) != plain(want)
    assert all(r.fatal == (r.kind in C.FATAL) for r in got)


def test_gate_needs_no_similarities(spark):
    a, b = texts()
    frames = [spark.createDataFrame(list(enumerate(x)), "id long, text string") for x in (a, b)]
    found = C.screen(*frames, similar=False)
    want = [x[:3] for x in brute(enumerate(a), list(enumerate(b)), "base", False)[0]]
    permitted = spark.createDataFrame([(i, j) for i, _, j in want[::2]], "left_id long, right_id long")
    got = [tuple(r) for r in C.containment_gate(found, permitted).collect()]
    assert sorted(got) == sorted(x for x in want if (x[0], x[2]) not in {(i, j) for i, _, j in want[::2]}) != []


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("block", [300, 1 << 21])
def test_maxima_and_ties(spark, monkeypatch, largest, block):
    monkeypatch.setattr(R, "BLOCK", block)
    a, b = texts()
    left, right = list(enumerate(a)), list(enumerate(b, 100))
    frames = [spark.createDataFrame(x, "id long, text string") for x in (left, right)]
    found, top = brute(left, right, "base")

    def best(i, k):
        s = max((x for x, _ in top.get((i, k), [])), default=0)
        return (s, (max if largest else min)(j for x, j in top[i, k] if x == s)) if s else (0.0, None)

    want = [(i, i in {x[0] for x in found}, *best(i, 2), *best(i, 3)) for i, _ in left]
    assert sorted(tuple(r) for r in C.maxima(*frames, largest_label=largest).collect()) == want
    none = C.maxima(frames[0], frames[1].limit(0)).collect()
    assert sorted(tuple(r) for r in none) == [(i, False, 0.0, None, 0.0, None) for i, _ in left]
    twice = C.maxima(frames[0].union(frames[0]).selectExpr("id % 7 as id", "text"), frames[1]).collect()
    assert sorted((r.left_id, r.token) for r in twice) == [(m, max(w[2] for w in want if w[0] % 7 == m)) for m in range(7)]


def test_all_filtered_makes_grams_once(monkeypatch):
    left, right = (list(enumerate(x)) for x in texts())
    refs = list(R.blocks(right, pa.int64(), True, "all_filtered"))
    batches = pa.Table.from_pylist([{"id": i, "text": t} for i, t in left]).to_batches()
    made, keys = [], R.gram_keys
    monkeypatch.setattr(R, "gram_keys", lambda x: made.extend(x) or keys(x))
    assert [r for x in refs for r in R.collisions(x, batches, True)]
    assert len(made) == sum(bool(R.normalized(t)) for _, t in left)


@pytest.mark.parametrize("variant", ["base", "tokens_filtered", "all_filtered"])
def test_holds_from_within_words(variant):
    rnd = random.Random(9)
    whole = [" ".join(rnd.choices("the of and is alpha beta gamma delta than other lands x yz".split(), k=30)) for _ in range(40)]
    cut = [t[a : a + rnd.randint(20, 60)] for t in whole for a in (0, rnd.randint(1, 40))] + ["theofandistheofandisth", "the of and is the of and", "he of and is the of an"]
    for a, b in ((whole, cut), (cut, whole), ([*whole, *cut], [*cut, *whole])):
        left, right = list(enumerate(a)), list(enumerate(b))
        batches = pa.Table.from_pylist([{"id": i, "text": t} for i, t in left]).to_batches()
        got = [tuple(r.values()) for refs in R.blocks(right, pa.int64(), True, variant) for x in R.collisions(refs, batches, True) for r in x.to_pylist()]
        assert plain(got) == plain(brute(left, right, variant)[0])


def test_grams_of_short_and_long_pieces(monkeypatch):
    some = [b"", b"a", b"ab", b"", b"abcd", b"abcde", b"abcdef", b"", b"zzzzzzzz", b""]
    want = sorted((i, t[k : k + 5]) for i, t in enumerate(some) if t for k in range(max(1, len(t) - 4)))
    for chunk in (1, 3, 100):
        monkeypatch.setattr(R, "CHUNK", chunk)
        keys = R.gram_keys(some)
        assert [k >> R.BITS for k in keys.tolist()] == [i for i, _ in sorted(set(want))] and len(R.gram_keys([b"", b""])) == 0


@pytest.mark.parametrize("variant", ["tokens_filtered", "all_filtered"])
def test_words_of_texts_are_split_once(monkeypatch, variant):
    left, right = (list(enumerate(x)) for x in texts())
    refs = list(R.blocks(right, pa.int64(), True, variant))
    batches = pa.Table.from_pylist([{"id": i, "text": t} for i, t in left]).to_batches()
    seen, words_in = [], R.words_in
    monkeypatch.setattr(R, "words_in", lambda *x: seen.append(x) or words_in(*x))
    assert [r for x in refs for r in R.collisions(x, batches, True)] and len(seen) == len(left)
