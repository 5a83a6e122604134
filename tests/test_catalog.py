"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from textloom.plans import catalog, governance, membership  # noqa: F401  these add their queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(catalog.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_defang(spark):
    from pyspark.sql import functions as F

    from textloom.functions import text

    rows = spark.createDataFrame([("#" * n,) for n in range(9)], "t string").select(text.defang_markers(F.col("t"))).collect()
    for n, (got,) in enumerate(rows):
        want = "#" * n if n < 3 else "‌".join("#" * min(2, n - i) for i in range(0, n, 2))
        assert got == want


def test_normalize_folds_compatibility_characters(spark):
    from pyspark.sql import functions as F

    from textloom.functions import text

    assert spark.createDataFrame([("ﬁne  Text!",), (None,)], "t string").select(text.normalize(F.col("t"))).collect() == [("fine text",), (None,)]


def test_parse_errors(spark):
    from pyspark.sql import functions as F

    from textloom.functions import formats as M

    n, b, a, bi, ai = M.NARRATIVE, M.BULLETS, M.ACTIONS, M.BULLET_ITEM, M.ACTION_ITEM
    cases = {f"{n}\nx\n{b}\n{bi} one\n{bi} two\n{a}\n{ai} do": None, f"{n} x {a} {b}": "out_of_order", f"{n} x {b}": "missing_actions", f"{n}{n} x {b} {a}": "duplicated_narrative", f"y {n} x {b} {a}": "preamble", f"{n} {b} {a}": "narrative_empty", f"{n} x {b} {ai} z {a}": "bullets_leakage", f"{n} x {b} z {a}": "bullets_bare", f"{n} x {b} {bi} {bi} z {a}": "bullets_empty_item", f"{n} x {b} {a}": None}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select(M.parse_v2(F.col("t")).alias("p")).collect()
    assert [r.p.error for r in got] == list(cases.values())
    assert got[0].p.bullets == ["one", "two"] and got[0].p.actions == ["do"]


def test_governance_edges(spark):
    from pyspark.sql import functions as F

    from textloom.operators import governance as G

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "id long, fp string")
    assert sorted(r.id for r in G.shared_fingerprints(rows, "fp").collect()) == [1, 4]
    pairs = spark.createDataFrame([("sha256:ab", "ab"), (None, None), ("ab", None)], "a string, b string")
    assert [r[0] for r in pairs.select(G.same_fingerprint(F.col("a"), F.col("b"))).collect()] == [True, True, False]
    dims = "map<string,boolean>"
    cases = [("accept", {"x": True}, True), ("accept", {"x": False}, False), ("accept", {"x": None}, False), ("reject", {"x": False}, True), ("reject", {"x": True}, False), ("else", {"x": True}, False), ("accept", {}, False), (None, {"x": True}, False), ("accept", None, False)]
    got = spark.createDataFrame([c[:2] for c in cases], f"v string, d {dims}").select(G.coherent_verdict(F.col("v"), F.col("d")))
    assert [r[0] for r in got.collect()] == [c[2] for c in cases]
    seq = lambda *v: spark.createDataFrame(list(enumerate(v)), "i long, v string")
    faults = G.sequence_faults(seq("a", "x", "c", "d"), seq("a", "b"), seq("c"), "i", "v").collect()
    assert sorted((r.i, r.fault) for r in faults) == [(1, "different"), (3, "extra")]
    assert G.sequence_faults(seq("a"), seq("a").limit(0), seq("a"), "i", "v").collect() == []


def test_queries_fold_compatibility_characters(spark, tmp_path):
    import hashlib
    import re
    import unicodedata
    from collections import Counter

    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    plain_text = "The first offices of the final flight were 25 metres high"
    docs = [(1, wide(plain_text), "a"), (2, plain_text, "a"), (3, plain_text.replace("fi", "ﬁ").replace("ffi", "ﬃ").replace("25", "²⁵"), "b"), (4, "Ⅷ ﬂags ™ ½", "b"), (5, "Nothing of the kind", "b"), (6, wide(plain_text) + " and so on", "a")]
    items = [(1, plain_text), (2, "viii flags tm 1 2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()

    def norm(t):
        return " ".join(re.sub("[^a-z0-9 ]", " ", unicodedata.normalize("NFKC", t).lower()).split())

    def grams(t):
        s = norm(t).replace(" ", "")
        return {s[i : i + 5] for i in range(max(1, len(s) - 4))}

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    like = lambda a, b: len(a & b) / len(a | b)
    want, best = set(), {}
    for i, t, _ in docs:
        for j, u in items:
            a, b = norm(t), norm(u)
            if a == b:
                want.add((i, "normalized_exact_match", j, None))
            elif min(len(a), len(b)) >= 20 and (a in b or b in a):
                want.add((i, "normalized_containment", j, None))
            w, g = like(set(a.split()), set(b.split())), like(grams(t), grams(u))
            want |= {(i, "token_jaccard_threshold", j, round(w, 6))} if w >= 0.15 else set()
            want |= {(i, "character_5gram_jaccard_threshold", j, round(g, 6))} if g >= 0.1 else set()
            if w > best.get(i, (0, 0))[0]:
                best[i] = (w, j)
    assert {(r.left_id, r.kind, r.right_id, r.score) for r in run("collision_screen")} == want
    assert {(r.left_id, r.score, r.right_id) for r in run("nearest_reference")} == {(i, round(w, 9), j) for i, (w, j) in best.items()}
    many = Counter(norm(t) for _, t, _ in docs)
    assert {(r.fingerprint, r.n, r.first_id) for r in run("duplicate_texts")} == {(sha(k), n, min(i for i, t, _ in docs if norm(t) == k)) for k, n in many.items() if n > 1} != set()
    assert {(r.doc_id, r.norm_sha256, r.n_tokens, r.n_grams) for r in run("text_profile")} == {(i, sha(norm(t)), len(set(norm(t).split())), len(grams(t))) for i, t, _ in docs}
    assert {(r.source, r.n, r.content_sha256) for r in run("pool_fingerprint")} == {(s, len(x), sha("\n".join(sorted(x)))) for s in "ab" for x in [[norm(t) for _, t, q in docs if q == s]]}


def test_base_plus_delta_takes_the_size_of_its_base(spark, tmp_path):
    base, delta = [f"N{i}" for i in range(7)], [f"R{i}" for i in range(8)]
    spark.createDataFrame(list(enumerate(base)), "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(list(enumerate(delta)), "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = entry.queries()["base_plus_delta"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(4, "missing"), (5, "different"), (11, "different")}


def test_pool_fingerprint_gathers_no_source(spark, tmp_path):
    """Like the SQL over many batches, with null texts, sources and a source of null texts only; no row holds a source."""
    docs = [(i, None if i % 7 == 0 else "" if i % 11 == 0 else f"Text {i * 37 % 101}, No. {i % 5}!", [None, "a", "a", "a", "b"][i % 5]) for i in range(200)]
    docs += [(200, None, "c"), (201, None, "c"), (202, "", "d"), (203, None, "e"), (204, "x", "e"), (205, "", "e")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalog.SQL["pool_fingerprint"]).fetchall()
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "3")
    try:
        df = entry.queries()["pool_fingerprint"](spark, str(tmp_path))
        assert sorted(map(tuple, df.select("source", "n", "content_sha256").collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set(rows, before)
    assert ("c", 2, None) in want and len(want) == 6
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan
