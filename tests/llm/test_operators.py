"""The operators against brute force on small rows with every odd case."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import common, decontam, html_extract, line_dedup, media, ngram_join, quality, sp_encode, substring_dedup, token_output, warc

random.seed(7)
VOCABULARY = [f"w{i}" for i in range(400)]


def words(n, vocabulary=VOCABULARY):
    return " ".join(random.choice(vocabulary) for _ in range(n))


def corpus():
    """Nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    passage, base = words(60), words(120).split()
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "ÀÉ x y — z"), (None, words(30)), (None, "one two")]
    for i in range(10, 40):
        near = list(base)
        for _ in range(i % 5):
            near[random.randrange(len(near))] = f"new{i}"
        rows.append((i, " ".join(near)))
    rows += [(i, f"{words(20)}\n{passage}\n{words(20)}") for i in range(40, 60)]
    rows += [(60, words(9000)), (61, passage), (61, passage), (62, words(40) + "\n" + words(12)), (63, "a\na\n\na b c d e\nA b c d f e\n")]
    return rows


def frame(spark, rows, extra=True):
    if extra:  # columns whose names the operators use themselves
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n long")
    return spark.createDataFrame(rows, "doc_id long, text string")


def same(got, want):
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_ngram_join(spark):
    rows = corpus()
    same(ngram_join.similar_components(spark, frame(spark, rows), 4, 85, 100).collect(), ngram_join.brute_force(rows, 4, 85, 100))
    kept = ngram_join.keep_one(spark, frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "n"]
    assert ngram_join.similar_components(spark, frame(spark, []), 4, 85, 100).count() == 0


def kept_rows(rows, *args):
    """keep_one by brute force, row by row."""
    return [r for r, (d, n, c) in zip(rows, ngram_join.brute_force(rows, *args), strict=True) if n == 0 or c is None or d == c]


def test_link_counts(spark):
    rows = odd_ids()
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = [(i, len(s), sum(j != n and bool(s) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets))) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]
    assert any(0 < x < 29 for _, _, x in want)
    same(ngram_join.link_counts(spark, frame(spark, rows)).collect(), want)


def odd_ids():
    """Rows without an id, and rows that repeat one with another text, some of them near copies."""
    rows, base = corpus(), words(50)
    alone = words(30)
    return rows + [(None, base + " a"), (None, base + " b"), (None, alone), (None, alone), (None, " "), (None, None), (70, base), (71, base + " c"), (71, words(30)), (71, ""), (6, base + " d"), (6, words(25))]


def test_keep_one_judges_each_row(spark):
    rows = odd_ids()
    want = kept_rows(rows)
    assert len([r for r in want if r[0] is None]) > 4 and len([r for r in want if r[0] == 71]) == 2
    same([(r.doc_id, r.text) for r in ngram_join.keep_one(spark, frame(spark, rows)).collect()], want)


def test_substring_dedup(spark):
    rows = corpus()
    for size in (1 << 20, 50):  # one group, and many groups of long prefixes
        out = substring_dedup.with_repeats(spark, frame(spark, rows), group_size=size).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        same(out.collect(), substring_dedup.brute_force(rows))
    assert substring_dedup.with_repeats(spark, frame(spark, [])).count() == 0


def test_line_dedup(spark):
    rows = corpus()
    out = line_dedup.remove_lines(spark, frame(spark, rows))
    assert out.columns == ["doc_id", "text", "key", "n"] and out.count() == len(rows)
    same(out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).collect(), [(i, h) for i, _, _, h in line_dedup.brute_force(rows)])
    assert line_dedup.remove_lines(spark, frame(spark, [])).count() == 0


def test_line_dedup_tells_rows_apart(spark):
    a, b, c = words(9), words(9), words(9)
    rows = [(1, f"{a}\n{words(9)}"), (None, f"{words(9)}\n{a}\n{words(9)}"), (None, f"{words(9)}\n{words(9)}\n{words(9)}"), (None, words(9)), (None, b + "\n" + words(9)), (None, b + "\n" + words(9))]
    rows += [(5, f"{a}\n{words(9)}"), (5, f"{words(9)}\n{c}"), (5, f"{words(9)}\n{c}"), (6, c), (6, None), (None, None), *odd_ids()]
    found = line_dedup.brute_texts(rows)
    assert len([k for (i, _), (_, k) in zip(rows[:6], found, strict=False) if i is None and len(k) == 3]) == 1
    assert sum(b in k for _, k in found) == 1 and all(n >= len(k) for n, k in found if n)
    got = line_dedup.remove_lines(spark, frame(spark, rows)).collect()
    same([(r.doc_id, r.text) for r in got], [(i, None if t is None else "\n".join(k)) for (i, t), (_, k) in zip(rows, found, strict=True)])
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{(at := common.new_path(spark, 'rows'))}/documents.parquet")
    same(line_dedup.op4(spark, at).collect(), line_dedup.brute_force(rows))


def test_rarity_is_made_without_pandas(spark, monkeypatch):
    from pyspark.sql import DataFrame
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("gathered by the driver"))
    texts = spark.createDataFrame([("once twice  often",), ("twice",)] + [("often often",)] * 500, "raw string")
    size = line_dedup.FEWEST
    scale = line_dedup.rarity(texts, size).first()["scale"]
    at = spark.range(1).select(*(line_dedup.bucket(F.xxhash64(F.lit(w)), size).alias(w) for w in ("once", "twice", "often"))).first()
    assert len(scale) == size and {i: x for i, x in enumerate(scale) if x} == {at.twice: 4, at.often: 39}


def test_line_dedup_of_templates_writes_few_pairs(spark):
    """Lines of ten common words and two of their own are no near copies; lines with one word changed are."""
    common_words = words(10, [f"c{i}" for i in range(10000)])
    rows = [(i, f"{common_words} a{i} b{i % 50}") for i in range(400)]
    long = words(30, [f"d{i}" for i in range(10000)]).split()
    rows += [(1000 + i, " ".join([*long[: i % 30], f"x{i}", *long[i % 30 + 1 :]])) for i in range(400)]
    docs = frame(spark, rows)
    vertex = line_dedup.vertices(spark, line_dedup.lines_of(docs))
    texts = common.materialize(spark, line_dedup.vertex_texts(docs, vertex), "texts")
    sets = common.materialize(spark, line_dedup.prefixes(texts, line_dedup.rarity(texts, 1 << 16), 1 << 16, 80, 100), "sets")
    star = line_dedup.earliest(sets, 80, 100)
    assert 390 < star.count() < line_dedup.SLOTS * len(rows)
    settled = line_dedup.matching(spark, texts, star, 80, 100)
    assert settled.count() >= 395
    assert line_dedup.candidates(sets, settled, 80, 100).count() < 800
    same([(r.doc_id, r.text) for r in line_dedup.remove_lines(spark, docs).collect()], [(i, "\n".join(k)) for (i, _), (_, k) in zip(rows, line_dedup.brute_texts(rows), strict=True)])


def test_line_dedup_with_clashing_names(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, __key long, __gone long, __row long, P long")
    out = line_dedup.remove_lines(spark, docs)
    assert out.columns == docs.columns and out.select("__key", "__gone", "__row", "P").distinct().collect() == [(1, 2, 3, 4)]
    same([(r.doc_id, r.text) for r in out.collect()], [(i, None if t is None else "\n".join(k)) for (i, t), (_, k) in zip(rows, line_dedup.brute_texts(rows), strict=True)])


def brute_cut(text, hit):
    """Text without the runs of hit words, each from its first word's start to its last word's end."""
    import re

    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    out, at = [], 0
    for n, (s, e) in enumerate(found):
        if n in hit:
            out.append(text[at : at if n - 1 in hit else s])
            at = e
    return "".join([*out, text[at:]])


def brute_benchmark(rows, items, window=decontam.WINDOW):
    import re

    def low(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins = {tuple(w[i : i + window]) for w in map(low, (t for _, t in items)) if w for i in range(max(1, len(w) - window + 1))}
    out = []
    for i, t in rows:
        w = low(t)
        hit = {p for k in {len(x) for x in wins} for at in range(len(w) - k + 1) if tuple(w[at : at + k]) in wins for p in range(at, at + k)}
        out.append((i, brute_cut(t, hit) if hit else t))
    return out


def test_pipeline_like_brute_force(spark):
    import hashlib

    import sentencepiece

    import corpus_pipeline

    junk = [(i, words(50).replace(" ", "$$$ ")) for i in range(400, 440)]
    rows = [*odd_ids(), *((i, words(50)) for i in range(300, 340)), *junk, (None, junk[0][1] + " x"), (300, junk[1][1] + " y")]
    items = [("1", rows[45][1].split("\n")[0]), ("2", rows[-80][1])]
    at = common.new_path(spark, "tables")
    spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i in range(301, 440) if i < 340 or i >= 400], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scored, name = quality.score(docs, quality.fit(docs, labels))
    want = [(r.doc_id, r.text) for r in scored.collect() if r[name] >= quality.THRESHOLD]
    assert {(i, t) for i, t in rows if 300 <= (i or 0) < 340 and "$" not in t} <= set(want) and not {t for _, t in want if t and "$$$" in t}
    cut = [(i, None if t is None else "\n".join(k)) for (i, t), (_, k) in zip(want, line_dedup.brute_texts(want), strict=True)]
    steps = [want, cut, kept_rows(cut), brute_benchmark(kept_rows(cut), items)]
    for (name, stage), rest in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = common.materialize(spark, stage(spark, docs, at), name)
        same([(r.doc_id, r.text) for r in docs.collect()], rest)
        assert docs.where("n_chars <> length(coalesce(text, ''))").count() == 0
    assert rest != steps[-2]
    lib = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(sp_encode.MODEL))
    ids = [(i, lib.encode(t or ""), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()) for i, t in rest]
    same([(r.doc_id, r.n_pieces, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect()], [(i, len(p), p, h) for i, p, h in ids])


def test_decontamination(spark):
    rows = corpus()
    items = [("1", rows[45][1]), ("2", "One two"), ("3", None), ("4", ""), ("10", rows[45][1]), ("5", words(30))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    import hashlib

    got = decontam.contamination(spark, frame(spark, rows), bench).collect()
    digest = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    same([(r.doc_id, r.n_words, r.n_hit, len(r["items"]), digest(r["items"])) for r in got], [(i, *x) for (i, _), x in zip(rows, decontam.brute_force([t for _, t in rows], items), strict=True)])
    clean = decontam.remove_contamination(spark, frame(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "key", "n"] and clean.count() == len(rows)
    assert decontam.contamination(spark, frame(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_many_blocks(spark):
    rows = corpus()
    items = [(str(i), words(25)) for i in range(6)] + [("7", rows[45][1])]
    blocks = [decontam.Phrases([(i, decontam.T.words_of(pa.array([t]), decontam.T.ALNUM_WORDS).hashes())], 10) for i, t in items]
    w = decontam.T.words_of(pa.array([t for _, t in rows], pa.string()), decontam.T.ALNUM_WORDS)
    hit, _ = decontam.find(w, blocks)
    assert hit.sum() == sum(x[1] for x in decontam.brute_force([t for _, t in rows], items))


def test_token_output(spark):
    rows = [r for r in corpus() if r[0] is not None] + [(70, "<|endoftext|> x"), (71, "é ÅΣΑΣ  ½ y")]
    path, tok = common.new_path(spark, "t"), common.tokenizer_path(token_output.TOKENIZER)
    token_output.write_tokens(frame(spark, rows), path, tok)
    same(token_output.read_tokens(spark, path).collect(), token_output.brute_force(rows, tok))
    assert spark.read.schema("doc_id long, start long, ids array<int>").orc(path).where("doc_id = 60").count() == 1


def test_media(spark):
    rows = corpus()
    got = media.media_features(media.encode_media(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.payload_bytes))
    assert all(len(v) == 1 for v in by_text.values())
    image = np.random.default_rng(1).integers(0, 256, (12, 64), np.uint8)
    kinds, out, above = np.arange(12) % 5, [], np.zeros(64, int)
    for k, row in zip(kinds, image.astype(int), strict=True):  # filtered by the definition, sample by sample
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], above[:-1]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        out.append((row - [0, left, above, (left + above) // 2, near][k]) % 256)
        above = row
    assert (media.unfilter(kinds, np.array(out, np.uint8)) == image).all()
    blob = bytearray(media.write_png(media.payload_of(b"abc" * 50)))
    assert media.read_png(bytes(blob)).tobytes() == media.payload_of(b"abc" * 50)
    blob[45] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(blob))


def test_warc(spark):
    rows = [(5, "http://a", "x"), (3, "http://b", "x"), (9, None, "x"), (4, "u\r\nv", None), (6, "e", ""), (None, "n", "x"), (3, "http://b", "x"), (8, "long", "é" * 200_000)]
    index = warc.write_archives(spark, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int"))
    got = warc.read_records(index).collect()
    want = [(5, 1, 3), (3, 1, None), (3, 1, None), (9, 1, 3), (None, 1, 3), (4, 0, None), (6, 0, 4), (8, 400_000, None)]
    same([(r.page_id, r.payload_bytes, r.refers_to) for r in got], want)
    assert {r.record_type for r in got if r.refers_to} == {"revisit"}
    assert [r.payload for r in warc.read_records(index.where("page_id = 8")).collect()] == ["é" * 200_000]


def test_html():
    page = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav><div class='cookie-notice'>We use cookies on this site, please agree to all of them now.</div><article><h1>Title &amp; more</h1><p>First <b>long</b> paragraph,\n with enough words to be taken for text.<p>Second<br>one &lt;here&gt;.<div class=ad>Buy this thing now, it is really cheap today.</div><p>Third paragraph ends the article.</article><section id=comments><p>I am a reader and this is what I have to say about it.</p></section><aside>Side</aside><form>Mail <input></form><footer>&copy; us</footer>"
    assert html_extract.main_text(page) == "Title & more\nFirst long paragraph, with enough words to be taken for text.\nSecond one <here>.\nThird paragraph ends the article."
    for broken in (None, "", "<", "<p", "<!--", "<script>x", "</p></div>", "<p>x</b></p>" * 3, "plain text " * 40):
        html_extract.main_text(broken)


LONG = "A long paragraph of the article with more than enough words in it to be taken for text by the score."


@pytest.mark.parametrize("before", ["<p class=\"x\"\">", "<p><a title=it's>Link</a> ", "<p title=\"never closed>", "<p><a href=/x?a=\"b>c</a> ", "<datalist><option value=a><option value=b></datalist><p>", "<datalist><option value=b></datalist><p>", "<div><button>Menu</div><p>", "<button>Menu<p>", "<select><option>A<option>B</select><p>", "<div><object data=x></div><p>", "<map name=m><area><p>", "<div><iframe src=a></div><p>", "<noscript><p>", "<div><svg><title>Icon</div><p>", "<video src=x><p>", "<math><mi>x<p>"])
@pytest.mark.parametrize("after", ["", "<p>Stray end tags </option></object></svg></textarea> and a single quote ' do no harm to this paragraph of words.</p>"])
def test_html_keeps_what_follows_broken_markup(before, after):
    got = html_extract.main_text(f"<body><article>{before}{LONG}</p><p>{LONG}</p>{after}</article></body>")
    assert got.count(LONG) == 2 and (not after or "do no harm" in got)


def test_html_drops_what_hidden_elements_hold():
    inside = "<select><option>Red one</select><select><option>Red<option>Blue</option></select><button><div>Press <b>this</b></div></button><noscript><img src=\"x><p>Enable it</noscript><svg><title>Icon</title><svg><path></svg><p>shape</svg><object><object><p>no</p></object><p>plug-in</p></object><template><div>later</div></template><iframe src='a>b'>frame</iframe><video><p>old browser</p></video><datalist><option value=a>Ay<option>Bee</datalist>"
    assert html_extract.main_text(f"<article><p>{LONG} {inside} {LONG}</p><p>{LONG}</p></article>") == f"{LONG} {LONG}\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article class="comments-enabled"><p>Body of it here.</p></article>', "Body of it here."),
        ('<div class="post"><p>Short.</p></div>', "Short."),
        ("<nav><a href=x>Home</a></nav>", ""),
        ('<section class="comments"><p>' + "a reader says. " * 20 + "</p></section>", ""),
        ("<section id='user-comments'><p>" + "a reader says. " * 20 + "</p></section>", ""),
    ],
)
def test_html_names_and_short_pages(page, text):
    assert html_extract.main_text(page) == text


def test_html_keeps_a_section_named_by_its_subject():
    page = "<article><p>" + "long text. " * 20 + '</p><section id="related-work"><p>' + "more of it. " * 10 + "</p></section></article>"
    assert html_extract.main_text(page).endswith("more of it.")


def test_html_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>" + "some words. " * 9), (2, None, ""), (3, "w", "<p>" + "x y. " * 50_000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, text int, n_chars int")
    same(html_extract.extract(pages).collect(), [(i, u, t, len(t)) for i, u, h in rows for t in [html_extract.main_text(h)]])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    at = common.new_path(spark, "none")
    none.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    from textloom.llm import queries

    for name, q in queries.queries().items():
        assert q(spark, at).count() == 0, name


def test_token_starts_with_several_files_a_task(spark):
    rows = [(i, words(1 + i % 7)) for i in range(90)]
    path, tok = common.new_path(spark, "ids"), common.tokenizer_path(token_output.TOKENIZER)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        token_output.write_tokens(frame(spark, rows), path, tok)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    same(token_output.read_tokens(spark, path).collect(), token_output.brute_force(rows, tok))


def test_html_time_is_in_proportion():
    import time

    for piece in ("<p a=\"b' c='", "<object>", "<option>", "<svg><path>", "<a =\"'", "<noscript>", "<p a=", "<button><div>"):
        start = time.process_time()
        html_extract.blocks_of(piece * 20_000)
        assert time.process_time() - start < 20, piece


def test_minimum_cut_is_least():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        e = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda k: sum(t[i] if k[i] else s[i] for i in range(n)) + sum(c for a, b, c in e if k[a] != k[b])  # noqa: B023, E731
        assert cost(html_extract.minimum_cut(s, t, e)) == min(map(cost, itertools.product([True, False], repeat=n)))


def test_sentencepiece():
    import sentencepiece

    path = common.tokenizer_path(sp_encode.MODEL)
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=path), sp_encode.Encoder(path)
    texts = ["", None, " ", "   a  b", "▁▁x ▁", "\x00a\n\t", "日本語 🙂", "a" * 3000, "thein" * 500 + " in", *(t for _, t in corpus())]
    ids, limits = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)] == [lib.encode(t or "") for t in texts]
    assert enc.decode(ids, limits) == [(t or "").replace("▁", " ") for t in texts]
    assert sp_encode.Encoder(path).encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_quality(spark):
    rows = [(i, words(50)) for i in range(150)] + [(i, words(50).replace(" ", "$$$ ")) for i in range(150, 300)] + [(300, None), (301, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scored, name = quality.score(docs.withColumns({"__score": F.lit(5), "__Words": F.lit(6)}), quality.fit(docs, labels))
    assert name == "__score_" and scored.select("__score", "__Words").distinct().collect() == [(5, 6)]
    scored = scored.drop("__score", "__Words").withColumnRenamed(name, "__score")
    assert scored.where("(__score >= 0.3) <> (doc_id < 150)").where("doc_id < 300").count() == 0
    assert scored.where("__score is null or __score < 0 or __score > 1").count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0)))[0].count() == len(rows)


def test_lowered_tells_all_characters_apart(spark):
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000), *range(0x1F000, 0x20000)]]
    pairs = [a + b for a in "aÃãあ" for b in "zÉéあ\U0001F600"]
    rows = spark.createDataFrame([(t,) for t in [*chars, *pairs]], "t string").select("t", line_dedup.lowered(F.col("t")).alias("l"))
    assert rows.agg(F.count_distinct("l")).first()[0] == len(set(chars) | set(pairs)) - 26
    assert rows.where("t between 'A' and 'Z' and length(t) = 1 and l <> lower(t)").count() == 0


def test_line_dedup_shuffles_candidate_rows_once(spark):
    import re

    from textloom.llm import line_dedup as L

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [[(2 << 56) + w for w in x] for x in ([1, 2, 3], [1, 2, 4], [5, 6, 7], [8, 6, 7])]
        sets = spark.createDataFrame([(p, 20, 0, 0, 0, w) for p, w in enumerate(words)], "p long, n int, alone int, bits long, odd long, prefix array<long>")
        df = L.candidates(sets, spark.createDataFrame([(0,)], "p long"), 80, 100)
        assert sorted(tuple(r) for r in df.collect()) == [(1, 0), (3, 2)]
        assert re.search(r"ReusedExchange.*hashpartitioning\(word", df._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_dedup_of_neighbours_shuffles_no_bitmaps(spark):
    import re

    from textloom.llm import line_dedup as L

    rows = [(0, 20, 0, 0, 0, [7, 8]), (1, 20, 0, 3, 0, [8]), (2, 20, 0, 0, 0, [9, 7]), (3, 20, 0, 2**60 - 1, 0, [7]), (4, 30, 0, 0, 0, [8]), (5, 20, 5, 0, 0, [9]), (6, 20, 0, 0, 0, [])]
    sets = spark.createDataFrame(rows, "p long, n int, alone int, bits long, odd long, neighbours array<long>")
    df = L.earliest(sets, 80, 100)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 0), (2, 0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and not re.search(r"(keys|functions)=\[[^]]*bits", plan)


def test_line_dedup_keeps_words_short(spark):
    from textloom.llm import line_dedup as L

    texts = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(30))) for i in range(6)], "p long, raw string")
    sets = L.prefixes(texts, L.rarity(texts, 1 << 16), 1 << 16, 80, 100).collect()
    assert all(r.prefix and r.neighbours and max(*r.prefix, *r.neighbours) < 1 << 40 for r in sets)
    assert all(a.neighbours == b.neighbours for a in sets for b in sets if a.p % 3 == b.p % 3)


def test_line_dedup_of_chance_pairs_compares_each_vertex_once(spark):
    """Forty vertices with one pair of words in common, and copies that share two."""
    rows = [(p, 20, 0, 0, 0, [7, 100 + p]) for p in range(40)] + [(50 + p, 20, 0, 0, 0, [8, 9, 200 + p]) for p in range(10)]
    sets = spark.createDataFrame(rows, "p long, n int, alone int, bits long, odd long, neighbours array<long>")
    pairs = sorted(tuple(r) for r in line_dedup.earliest(sets, 80, 100).collect())
    assert [x for x in pairs if x[0] < 50] == [(p, 0) for p in range(1, 40)]
    copies = [x for x in pairs if x[0] > 49]
    assert {b for b, a in copies if a == 50} == set(range(51, 60)) and len(copies) > 9


def test_line_dedup_of_single_pairs_compares_the_closest(spark):
    rows = [(p, 20, 0, 0 if p % 2 else 3, 0, [7, 100 + p]) for p in range(16)] + [(40, 20, 0, 0, 0, [7, 140])]
    sets = spark.createDataFrame(rows, "p long, n int, alone int, bits long, odd long, neighbours array<long>")
    assert [r.a % 2 for r in line_dedup.earliest(sets, 80, 100).where("b = 40").collect()] == [1]


def test_line_dedup_of_neighbours_parts_sizes(spark):
    """A pair of words in lines of 22 and 44 words is chance; copies of two kinds of sizes are found all the same."""
    lines = [" ".join(["x", "y", *(f"c{k}" for k in range(n - 2))]) for n in (22, 23, 44)] + [" ".join(f"c{k}" for k in range(44))] * 6
    texts = spark.createDataFrame(list(enumerate(lines)), "p long, raw string")
    a, b, c = (set(r.neighbours) for r in line_dedup.prefixes(texts, line_dedup.rarity(texts, 1 << 16), 1 << 16, 80, 100).where("p < 3").orderBy("p").collect())
    assert a & b and not a & c
    near = words(21, [f"e{i}" for i in range(10000)]).split()
    rows = [*enumerate(lines), (20, " ".join(near[:20])), (21, " ".join(near)), (22, " ".join(near[1:]))]
    found = line_dedup.brute_texts(rows)
    assert sum(k == [] for _, k in found) == 9
    same([(r.doc_id, r.text) for r in line_dedup.remove_lines(spark, frame(spark, rows)).collect()], [(i, "\n".join(k)) for (i, _), (_, k) in zip(rows, found, strict=True)])


def test_token_chunks_are_encoded_together(monkeypatch):
    """New chunks go many in one text, capitals with small letters; ids are those of whole texts in every odd case."""
    from tokenizers import Tokenizer

    path = common.tokenizer_path(token_output.TOKENIZER)
    odd = ["H\u0331 h\u0331 A\u0300 J\u030c", "a\x01b \x01 \x01\x01 c", "<|ENDOFTEXT|> <|endoftext|>a Abc", "ABC abc aBC's ABC'S", "", None, "É é İ ẞ ß Σ ς\u00a0x", "\u0331a \u0308 A"]
    texts = [*odd, *(words(40).title() for _ in range(30)), *odd]
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for places in (token_output.PLACES, 4):  # with four places nearly all chunks push each other out
        monkeypatch.setattr(token_output, "PLACES", places)
        enc = token_output.ChunkEncoder(path, 2)
        for some in (texts, *([t] for t in texts), texts):
            ids, limits = enc.encode(pa.array(some, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)] == (want if len(some) > 1 else [want[texts.index(some[0])]])
    enc = token_output.ChunkEncoder(path, 2)
    calls = []
    enc.tok = type("Counted", (), {"encode_batch_fast": lambda self, x, **k: calls.append(len(x)) or whole.encode_batch_fast(x, **k)})()
    enc.encode(pa.array(["Word wOrd word x" + " y".join(map(str, range(50)))]))
    assert calls == [1] and len(enc.size) == 1 + 51
