"""Runnable queries for the operators over the synthetic tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats as M
from ..functions import text as T
from ..operators import collision as C
from ..operators import curation as K
from ..operators import governance as G
from ..operators import ledger as L
from ..operators import reports as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
CONTENT = ", ".join(f"'{w}'" for w in T.CONTENT_STOPWORDS)
NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
TOK = "list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> ''))"
GRAMS = "CASE WHEN s = '' THEN [] WHEN length(s) < 5 THEN [s] ELSE list_distinct(list_transform(generate_series(1, length(s) - 4), lambda i: substr(s, CAST(i AS INTEGER), 5))) END"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents), t AS (SELECT doc_id, norm, replace(norm, ' ', '') AS s, {TOK} AS tok FROM n)
SELECT doc_id, sha256(norm) AS norm_sha256, CAST(length(s) AS BIGINT) AS norm_chars, CAST(len(tok) AS BIGINT) AS n_tokens,
CAST(len(list_filter(tok, lambda w: w NOT IN ({STOP}))) AS BIGINT) AS n_filtered, CAST(len(list_filter(tok, lambda w: length(w) > 1 AND w NOT IN ({CONTENT}))) AS BIGINT) AS n_content,
CAST(len({GRAMS}) AS BIGINT) AS n_grams FROM t""")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, T4, T5, T6, T9."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("n"))
    n = F.col("n")
    return d.select("doc_id", F.sha2(n, 256).alias("norm_sha256"), F.length(F.replace(n, F.lit(" "), F.lit(""))).cast("long").alias("norm_chars"), F.size(T.tokens(n)).cast("long").alias("n_tokens"), F.size(T.filtered_tokens(n)).cast("long").alias("n_filtered"), F.size(T.content_tokens(n)).cast("long").alias("n_content"), F.size(T.char_grams(n)).cast("long").alias("n_grams"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[''-]*[\p{L}\p{N}_][\p{L}\p{N}_''-]*')) AS BIGINT) AS words,
CAST(len(regexp_extract_all(text, '[^.!?]+[.!?](?:\s|$)')) AS BIGINT) AS sentences, regexp_matches(text, '\p{Cc}') AS control FROM documents""")
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10, T11, T25."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).cast("long").alias("words"), T.sentence_count(t).cast("long").alias("sentences"), T.has_control(t).alias("control"))


@query()
def marker_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T20."""
    t = F.concat(F.lit("###"), F.repeat(F.lit("#"), (F.col("page_id") % 9).cast("int")), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.defang_markers(t).alias("safe"))


_COLLIDE = f"""WITH a AS (SELECT doc_id AS id, {NORM} AS norm FROM documents), b AS (SELECT item_id AS id, {NORM} AS norm FROM benchmark),
ta AS (SELECT id, norm, replace(norm, ' ', '') AS s, {TOK} AS w FROM a WHERE norm <> ''), tb AS (SELECT id, norm, replace(norm, ' ', '') AS s, {TOK} AS w FROM b WHERE norm <> ''),
ga AS (SELECT id, norm, w, {GRAMS} AS g FROM ta), gb AS (SELECT id, norm, w, {GRAMS} AS g FROM tb),
p AS (SELECT ga.id AS a, gb.id AS b, ga.norm AS na, gb.norm AS nb, len(list_intersect(ga.w, gb.w)) AS ow, len(ga.w) + len(gb.w) AS sw, len(list_intersect(ga.g, gb.g)) AS og, len(ga.g) + len(gb.g) AS sg FROM ga, gb)"""


@query(_COLLIDE + """
SELECT a AS left_id, 'normalized_exact_match' AS kind, b AS right_id, CAST(NULL AS DOUBLE) AS score FROM p WHERE na = nb
UNION ALL SELECT a, 'normalized_containment', b, NULL FROM p WHERE na <> nb AND least(length(na), length(nb)) >= 20 AND (contains(na, nb) OR contains(nb, na))
UNION ALL SELECT a, 'token_jaccard_threshold', b, round(ow / (sw - ow), 6) FROM p WHERE ow / (sw - ow) >= 0.15
UNION ALL SELECT a, 'character_5gram_jaccard_threshold', b, round(og / (sg - og), 6) FROM p WHERE og / (sg - og) >= 0.10""")
def collision_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with all four kinds (T8, C9 and C10's exact part), documents against the benchmark."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return C.screen(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("id"), "text"))


@query(_COLLIDE + " SELECT a AS left_id, round(ow / (sw - ow), 9) AS score, min(b) AS right_id FROM p WHERE ow > 0 QUALIFY ow / (sw - ow) = max(ow / (sw - ow)) OVER (PARTITION BY a) GROUP BY a, ow, sw".replace(" QUALIFY ow / (sw - ow) = max(ow / (sw - ow)) OVER (PARTITION BY a) GROUP BY a, ow, sw", " AND (a, ow / (sw - ow)) IN (SELECT (a, max(ow / (sw - ow))) FROM p GROUP BY a) GROUP BY a, round(ow / (sw - ow), 9)"))
def nearest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best token score and the first reference that has it."""
    def side(name: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).alias("id"), T.tokens(T.normalize(F.col("text"))).alias("elements"))

    best = C.nearest(C.overlap_scores(side("documents", "doc_id"), side("benchmark", "item_id"), "score"), "score")
    return best.select("left_id", F.round("score", 9).alias("score"), "right_id")


@query(f"SELECT sha256({NORM}) AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9, A20."""
    return C.duplicate_groups(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.regexp_replace("text", "#", "").alias("text")))).alias("t"))
    of = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: M.strip(x["text"]))
    return c.select("conv_id", F.col("t")[0]["text"].alias("narrative"), of("user").alias("bullets"), of("assistant").alias("actions"))


_RECORDS = r"""WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': replace(text, '#', '')} ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, t[1].text AS narrative, list_transform(list_filter(t, lambda x: x.role = 'user'), lambda x: regexp_replace(x.text, '^\s+|\s+$', '', 'g')) AS bullets,
list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: regexp_replace(x.text, '^\s+|\s+$', '', 'g')) AS actions FROM c)"""


@query(_RECORDS + r""" SELECT conv_id, sha256(array_to_string(list_concat(['###NARRATIVE###', regexp_replace(narrative, '^\s+|\s+$', '', 'g'), '###BULLETS###'], bullets, ['###ACTIONS###'], actions), chr(10))) AS v1,
sha256(array_to_string(list_concat(['###NARRATIVE###', regexp_replace(narrative, '^\s+|\s+$', '', 'g'), '###BULLETS###'], list_transform(bullets, lambda x: '###BULLET### ' || x), ['###ACTIONS###'], list_transform(actions, lambda x: '###ACTION### ' || x)), chr(10))) AS v2,
regexp_replace(narrative, '^\s+|\s+$', '', 'g') <> '' AS valid FROM r""")
def target_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M3, P1."""
    r, cols = _records(spark, sf_dir), [F.col(c) for c in ("narrative", "bullets", "actions")]
    return r.select("conv_id", F.sha2(M.build_v1(*cols), 256).alias("v1"), F.sha2(M.build_v2(*cols), 256).alias("v2"), M.valid_v1(M.build_v1(*cols)).alias("valid"))


@query(_RECORDS + r""" SELECT conv_id, CASE WHEN regexp_replace(narrative, '^\s+|\s+$', '', 'g') = '' THEN 'narrative_empty' WHEN list_contains(bullets, '') THEN 'bullets_empty_item' WHEN list_contains(actions, '') THEN 'actions_empty_item' END AS error,
CASE WHEN regexp_replace(narrative, '^\s+|\s+$', '', 'g') <> '' AND NOT list_contains(bullets, '') AND NOT list_contains(actions, '') THEN CAST(len(bullets) AS BIGINT) END AS bullets,
CASE WHEN regexp_replace(narrative, '^\s+|\s+$', '', 'g') <> '' AND NOT list_contains(bullets, '') AND NOT list_contains(actions, '') THEN CAST(len(actions) AS BIGINT) END AS actions FROM r""")
def target_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2, M4: parsing what was built gives the items back."""
    r, cols = _records(spark, sf_dir), [F.col(c) for c in ("narrative", "bullets", "actions")]
    p = r.select("conv_id", "bullets", "actions", M.parse_v2(M.build_v2(*cols)).alias("p"))
    return p.select("conv_id", F.col("p.error").alias("error"), F.when(F.col("p.bullets") == F.col("bullets"), F.size("p.bullets").cast("long")).alias("bullets"), F.when(F.col("p.actions") == F.col("actions"), F.size("p.actions").cast("long")).alias("actions"))


@query(_RECORDS + " SELECT conv_id, 'conv:' || conv_id || ':output.' || f || coalesce(':' || lpad(CAST(i AS VARCHAR), 2, '0'), '') AS label, sha256(x) AS text_sha256 FROM (SELECT conv_id, 'narrative' AS f, NULL AS i, narrative AS x FROM r UNION ALL SELECT conv_id, 'bullets', unnest(generate_series(1, len(bullets))), unnest(bullets) FROM r WHERE len(bullets) > 0 UNION ALL SELECT conv_id, 'action_items', unnest(generate_series(1, len(actions))), unnest(actions) FROM r WHERE len(actions) > 0)")
def flatten_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P5, O2, F1."""
    r = _records(spark, sf_dir)
    parts = [r.select("conv_id", F.lit("narrative").alias("f"), F.lit(None).cast("int").alias("i"), F.col("narrative").alias("x"))]
    parts += [r.select("conv_id", F.lit(f).alias("f"), F.posexplode(c).alias("i", "x")) for f, c in (("bullets", "bullets"), ("action_items", "actions"))]
    leaves = parts[0].union(parts[1]).union(parts[2])
    tail = F.when(F.col("i").isNull(), "").otherwise(F.format_string(":%02d", F.col("i") + 1))
    return leaves.select("conv_id", F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":output."), "f", tail).alias("label"), F.sha2("x", 256).alias("text_sha256"))


@query("""WITH s AS (SELECT d.lang, d.source, CAST(l.quality = 1 AND l.toxic = 0 AS BIGINT) AS p FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT lang, source, sum(p) AS k, count(*) AS n FROM s GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, CAST(k AS BIGINT) AS passed, n AS total, CAST(k AS VARCHAR) || '/' || n || ' (' || CAST(CAST(round_even(100.0 * k / n, 0) AS INTEGER) AS VARCHAR) || '%)' AS rate FROM g""")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A4, over the ids that both tables have; id_set_faults names the others."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ok = K.probe_passes(F.lit(True), F.create_map(F.lit("quality"), F.col("quality") * 2), F.array(F.lit("quality")), F.create_map(F.lit("clean"), F.col("toxic") == 0))
    s = l.join(d, "doc_id").select("lang", "source", ok.cast("long").alias("p"))
    g = s.groupingSets([[], [F.col("lang")], [F.col("source")]], "lang", "source").agg(F.sum("p").alias("passed"), F.count("*").alias("total"))
    return g.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "passed", "total", M.percent(F.col("passed"), F.col("total")).alias("rate"))


@query("""SELECT d.lang, CASE WHEN count(*) FILTER (l.doc_id IS NULL) > 0 THEN NULL ELSE CAST(sum(CAST(l.quality = 1 AS BIGINT)) AS VARCHAR) || '/' || count(*) END AS rate, count(*) FILTER (l.doc_id IS NULL) AS unscored, CAST(sum(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS strict
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang""")
def strict_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate is null if any row isn't scored."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    strict = R.strict_pass(F.lit(True), F.create_map(F.lit("quality"), F.col("quality") == 1), ["quality"], F.create_map(F.lit("clean"), F.col("toxic") == 0))
    unscored = F.count_if(F.col("quality").isNull())
    return d.groupBy("lang").agg(F.when(unscored > 0, F.lit(None)).otherwise(F.concat(F.sum((F.col("quality") == 1).cast("long")).cast("string"), F.lit("/"), F.count("*").cast("string"))).alias("rate"), unscored.alias("unscored"), F.sum(F.coalesce(strict, F.lit(False)).cast("long")).alias("strict"))


@query("""SELECT lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 2) AS mean, median(n_chars) AS median,
list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, list_sort(list(n_chars))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95 FROM documents GROUP BY lang""")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and p95 by rank, from a count per value rather than a list per group."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("v"))
    plain = d.groupBy("lang").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 2).alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"))
    upto = d.groupBy("lang", "v").count().withColumn("upto", F.sum("count").over(Window.partitionBy("lang").orderBy("v")))
    j = upto.join(plain, "lang")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return j.groupBy("lang", "n", "least", "most", "mean", "median").agg(at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.bround(F.lit(0.95) * (F.col("n") - 1), 0)).alias("p95"))


@query("SELECT event_type AS label, count(*) AS n, min(event_id) AS first_seen, rank() OVER (ORDER BY count(*) DESC, min(event_id)) AS position FROM events GROUP BY event_type")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: most frequent first, ties in the order first seen."""
    h = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))
    return h.withColumn("position", F.rank().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum((CAST(floor(l_quantity) AS BIGINT) * 300000 + 999999) // 1000000 + (CAST(floor(l_extendedprice) AS BIGINT) * 2500 + 999999) // 1000000) AS BIGINT) AS cost FROM lineitem GROUP BY ALL""")
def ceiling_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole millionths, each part rounded up."""
    cost = L.ceiling_cost(F.col("l_quantity").cast("long"), 300_000) + L.ceiling_cost(F.col("l_extendedprice").cast("long"), 2_500)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(cost).alias("cost"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(value * 1000) AS BIGINT) AS cost FROM events), s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT user_id, count(*) AS n, min(CASE WHEN before + 50000 > 225000 THEN event_id END) AS first_refused, CAST(max(before) AS BIGINT) AS spent FROM s GROUP BY user_id""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("value") * 1000).cast("long").alias("cost"))
    g = L.budget_gate(e, "user_id", "event_id", "cost", 50_000, 225_000)
    return g.groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.when(~F.col("fits"), F.col("event_id"))).alias("first_refused"), F.max("spent_before").alias("spent"))


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
c AS (SELECT user_id, sequence, CAST(NULL AS VARCHAR) AS prior_row_hash, sha256('{"payload":"' || payload || '","prior_row_hash":null,"sequence":1}' || chr(10)) AS row_hash FROM e WHERE sequence = 1
UNION ALL SELECT e.user_id, e.sequence, c.row_hash, sha256('{"payload":"' || e.payload || '","prior_row_hash":"' || c.row_hash || '","sequence":' || e.sequence || '}' || chr(10)) FROM c JOIN e ON e.user_id = c.user_id AND e.sequence = c.sequence + 1)"""


@query(_CHAIN + " SELECT user_id, CAST(sequence AS INTEGER) AS sequence, prior_row_hash, row_hash FROM c")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1."""
    return L.build_chain(table(spark, sf_dir, "events").withColumnRenamed("event_type", "payload"), "user_id", "event_id", "payload").drop("payload")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN 3 END AS first_broken FROM events GROUP BY user_id")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: every third row's payload was tampered with."""
    c = L.build_chain(table(spark, sf_dir, "events").withColumnRenamed("event_type", "payload"), "user_id", "event_id", "payload")
    return L.verify_chain(c.withColumn("payload", F.when(F.col("sequence") % 3 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))), "user_id")


_ROW = "sha256('{{\"kind\":\"' || kind || '\",\"label\":' || coalesce('\"' || label || '\"', 'null') || ',\"number\":' || number || ',\"prior_row_hash\":{0},\"sequence\":' || {1} || ',\"step\":' || step || '}}' || chr(10))"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END AS label, event_id AS number, event_id % 7 AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events),
c AS (SELECT user_id, sequence, CAST(NULL AS VARCHAR) AS prior_row_hash, {_ROW.format("null", "1")} AS row_hash FROM e WHERE sequence = 1
UNION ALL SELECT e.user_id, e.sequence, c.row_hash, {_ROW.format('"' + "' || c.row_hash || '" + '"', "e.sequence")} FROM c JOIN e ON e.user_id = c.user_id AND e.sequence = c.sequence + 1)
SELECT user_id, CAST(sequence AS INTEGER) AS sequence, prior_row_hash, row_hash FROM c""")
def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 for rows of several fields, with nulls and names on both sides of the chain's own."""
    return L.build_chain(_ledger(spark, sf_dir), "user_id", "number", ["kind", "label", "number", "step"]).select("user_id", "sequence", "prior_row_hash", "row_hash")


@query("SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 4 THEN 4 END AS first_broken FROM events GROUP BY user_id")
def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 for rows of several fields; one field of every fourth row was changed."""
    fields = ["kind", "label", "number", "step"]
    rows = L.build_chain(_ledger(spark, sf_dir), "user_id", "number", fields)
    return L.verify_chain(rows.withColumn("step", F.when(F.col("sequence") % 4 == 0, F.col("step") + 1).otherwise(F.col("step"))), "user_id", fields)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    label = F.when(i % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), label.alias("label"), i.alias("number"), (i % 7).alias("step"))


@query("""WITH h AS (SELECT *, sha256(text) AS h FROM documents), p AS (SELECT DISTINCT h FROM h WHERE doc_id % 10 = 3)
SELECT lang, CASE WHEN h IN (SELECT h FROM p) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM h GROUP BY ALL""")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in ten is pinned, and all rows with the same text go with it."""
    d = table(spark, sf_dir, "documents")
    pinned = d.where("doc_id % 10 = 3").select(F.sha2("text", 256).alias("input_sha256"))
    return K.split_by_manifest(d, pinned, "text").groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 11 <> 0)
SELECT doc_id, CASE WHEN a.lang IS NULL THEN 'added' WHEN b.lang IS NULL THEN 'removed' WHEN a.lang <> b.lang THEN 'changed' ELSE 'same' END AS change,
CASE WHEN a.lang <> b.lang THEN ['lang'] ELSE [] END AS changed_fields FROM a FULL JOIN b USING (doc_id)""")
def corpus_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: by id, without order (J4: corpus_order_diff) or an allow-list (J12: change_authorization)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    return K.diff(d.where("doc_id % 7 <> 0"), new, "doc_id", ["lang", "source"])


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 AND lang = 'en' THEN 'EN' ELSE lang END AS lang, doc_id % 6 = 0 AND lang <> 'en' AS drift FROM documents")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    c = d.where("doc_id % 6 = 0").select("doc_id", F.lit("en").alias("current"), F.lit("EN").alias("corrected"))
    return K.apply_corrections(d, c, "doc_id", "lang")


@query("""WITH a AS (SELECT doc_id, quality, toxic FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels WHERE doc_id % 9 <> 0)
SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.quality <> b.quality THEN 'disagreement' ELSE 'aligned' END AS outcome, CASE WHEN a.quality <> b.quality THEN 'quality' ELSE '' END AS differing FROM a LEFT JOIN b USING (doc_id)""")
def reviewer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, G3."""
    a = table(spark, sf_dir, "labels")
    b = a.where("doc_id % 9 <> 0").withColumn("quality", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    d = K.diff(a, b, "doc_id", ["quality", "toxic"])
    return d.select("doc_id", F.when(F.col("change") == "removed", "missing").when(F.col("change") == "changed", "disagreement").otherwise("aligned").alias("outcome"), F.array_join("changed_fields", ",").alias("differing"))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, 77 * n / sum(n) OVER () AS raw FROM s), l AS (SELECT *, CAST(floor(raw) AS BIGINT) AS low FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY round(raw - low, 9) DESC, sha256('seed' || source)) AS rk, sum(low) OVER () AS total FROM l) SELECT source, n, low + CAST(rk <= 77 - total AS BIGINT) AS quota FROM k""")
def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O7."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return K.largest_remainder(s, "n", "source", 77, "seed")


@query("SELECT CAST(c AS INTEGER) AS card, CAST(2 * c - CASE WHEN (m = 'A') = (c % 2 = 1) THEN 1 ELSE 0 END AS INTEGER) AS slot, m AS model FROM generate_series(1, 12) t(c), (VALUES ('A'), ('B')) v(m)")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve cards by two models, the order turned on even cards."""
    cards = spark.range(1, 13).select(F.col("id").cast("int").alias("card"), F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))).alias("model"))
    first = F.col("model") == F.when(F.col("card") % 2 == 0, "B").otherwise("A")
    return cards.select("card", (2 * F.col("card") - first.cast("int")).cast("int").alias("slot"), "model")


@query("""WITH s AS (SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 2 THEN 'invalidated' WHEN 1 THEN 'superseded' ELSE 'active' END AS status FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(status, 'active') AS status FROM customer LEFT JOIN s ON user_id = c_custkey""")
def active_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "purchase", "invalidated").when(F.col("event_type") == "click", "superseded").alias("status"))
    return K.active_status(table(spark, sf_dir, "customer").select("c_custkey"), events, ["c_custkey"])


@query("""WITH r AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 50 = 0), a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM r)), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM a))
SELECT 0 AS depth, id FROM r UNION ALL SELECT 1, id FROM a UNION ALL SELECT 2, id FROM b""")
def withdrawal_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on withdrawn roots, by semi joins of fixed depth."""
    roots = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_suppkey").alias("child"))
    return K.closure(roots, [orders, items]).select("depth", "id")


@query("""WITH t AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a, event_type AS b FROM events) SELECT user_id, count(*) AS n_transitions, CAST(sum(CASE WHEN a || '>' || b IN ('view>click', 'click>purchase', 'view>view') THEN 0 ELSE 1 END) AS BIGINT) AS n_bad FROM t WHERE a IS NOT NULL GROUP BY user_id""")
def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, L13."""
    return K.transitions(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", [("view", "click"), ("click", "purchase"), ("view", "view")])


@query("SELECT doc_id, list_filter([CASE WHEN trim(text) = '' THEN 'blank_text' END, CASE WHEN n_chars > 5000 THEN 'too_long' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END], lambda x: x IS NOT NULL) AS violations FROM documents")
def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2 in part (rules on columns, not the record's shape or exact keys): all broken rules of a row, in order."""
    rules = [("blank_text", F.trim("text") != ""), ("too_long", F.col("n_chars") <= 5000), ("language", F.col("lang").isin("en", "de"))]
    return table(spark, sf_dir, "documents").select("doc_id", K.violations(rules).alias("violations"))


@query(f"WITH n AS (SELECT source, {NORM} AS norm FROM documents) SELECT source, count(*) AS n, sha256(string_agg(norm, chr(10) ORDER BY norm)) AS content_sha256 FROM n GROUP BY source")
def pool_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, A16 by source (pool_total has the row over all): sorted normalized texts of a source, joined by a line feed."""
    return G.sorted_contents(table(spark, sf_dir, "documents").select("source", T.normalize(F.col("text")).alias("norm")), "source", "norm")
