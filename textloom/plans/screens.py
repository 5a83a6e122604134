"""Queries of the collision screens' presets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import collision as C
from .catalog import GRAMS, NORM, STOP, TOK, query, table

_WORDS = "array_to_string(list_filter(string_split(norm, ' '), lambda w: w NOT IN ({0})), '')".format(STOP)
_FILTERED = f"list_filter({TOK}, lambda w: w NOT IN ({STOP}))"


def _pairs(words: str, grams: str) -> str:
    return f"""WITH a AS (SELECT doc_id AS id, {NORM} AS norm, source FROM documents), b AS (SELECT item_id AS id, {NORM} AS norm FROM benchmark),
ta AS (SELECT *, {grams} AS s, {words} AS w FROM a WHERE norm <> ''), tb AS (SELECT *, {grams} AS s, {words} AS w FROM b WHERE norm <> ''),
ga AS (SELECT *, {GRAMS} AS g FROM ta), gb AS (SELECT *, {GRAMS} AS g FROM tb),
q AS (SELECT ga.id AS a, gb.id AS b, ga.source, ga.norm AS na, gb.norm AS nb, len(list_intersect(ga.w, gb.w)) AS ow, len(ga.w) + len(gb.w) AS sw, len(list_intersect(ga.g, gb.g)) AS og, len(ga.g) + len(gb.g) AS sg FROM ga, gb),
p AS (SELECT *, CASE WHEN sw > ow THEN ow / (sw - ow) ELSE 0 END AS tok, CASE WHEN sg > og THEN og / (sg - og) ELSE 0 END AS gram,
 na <> nb AND least(length(na), length(nb)) >= 20 AND (contains(na, nb) OR contains(nb, na)) AS held FROM q)"""


_BASE = _pairs(TOK, "replace(norm, ' ', '')")
_KINDS = """SELECT a AS left_id, 'normalized_exact_match' AS kind, b AS right_id, CAST(NULL AS DOUBLE) AS score FROM p WHERE na = nb
UNION ALL SELECT a, 'normalized_containment', b, NULL FROM p WHERE held
UNION ALL SELECT a, 'token_jaccard_threshold', b, round(tok, 6) FROM p WHERE tok >= 0.15
UNION ALL SELECT a, 'character_5gram_jaccard_threshold', b, round(gram, 6) FROM p WHERE gram >= 0.10"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


@query(_pairs(_FILTERED, "replace(norm, ' ', '')") + _KINDS)
def screen_tokens_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words left out of the token side."""
    a, b = _sides(spark, sf_dir)
    return C.screen(a, b, variant="tokens_filtered")


@query(_pairs(_FILTERED, _WORDS) + _KINDS)
def screen_all_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words left out of both sides; equality and containment use whole texts."""
    a, b = _sides(spark, sf_dir)
    return C.screen(a, b, variant="all_filtered")


@query(_BASE + """SELECT a AS left_id, 'normalized_exact_match' AS kind, b AS right_id, CAST(NULL AS DOUBLE) AS score, true AS fatal FROM p WHERE na = nb
UNION ALL SELECT a, 'normalized_containment', b, NULL, true FROM p WHERE held
UNION ALL SELECT a, 'token_jaccard_threshold', b, round(tok, 6), false FROM p WHERE tok >= 0.15 AND na <> nb AND NOT held
UNION ALL SELECT a, 'character_5gram_jaccard_threshold', b, round(gram, 6), false FROM p WHERE gram >= 0.10 AND na <> nb AND NOT held""")
def sampling_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: equality and containment are fatal and end a pair's report; similarities are for review."""
    a, b = _sides(spark, sf_dir)
    return C.review(C.screen(a, b))


@query(_BASE + """SELECT doc_id AS left_id, coalesce(bool_or(na = nb OR held OR tok >= 0.15 OR gram >= 0.10), false) AS fatal, round(coalesce(max(tok), 0), 9) AS token, round(coalesce(max(gram), 0), 9) AS gram
FROM documents LEFT JOIN p ON a = doc_id GROUP BY doc_id""")
def selection_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any collision is fatal; the two best scores of each text, without labels."""
    return C.maxima(*_sides(spark, sf_dir)).select("left_id", "fatal", F.round("token", 9).alias("token"), F.round("gram", 9).alias("gram"))


@query(f"""WITH x AS (SELECT item_id AS id, text, {NORM} AS norm, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +'), lambda w: w <> '')) AS w FROM benchmark),
y AS (SELECT *, replace(norm, ' ', '') AS s FROM x), z AS (SELECT *, {GRAMS} AS g FROM y),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / greatest(1, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS tok, len(list_intersect(a.g, b.g)) / greatest(1, len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS gram FROM z a, z b WHERE a.id <> b.id)
SELECT a AS left_id, round(max(tok), 4) AS token, max_by(b, (tok, b)) FILTER (tok > 0) AS token_nearest, round(max(gram), 4) AS gram, max_by(b, (gram, b)) FILTER (gram > 0) AS gram_nearest, max(tok) >= 0.15 OR max(gram) >= 0.10 AS needs_disposition FROM p GROUP BY a""")
def repair_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score and nearest reference by both metrics, ties to the largest label, each item against the others."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", T.normalize(F.col("text")).alias("norm"))
    out = b.select(F.col("id").alias("left_id"))
    for name, elements in (("token", T.repair_tokens(F.col("text"))), ("gram", T.char_grams(F.col("norm")))):
        side = b.select("id", elements.alias("elements"))
        best = C.nearest(C.overlap_scores(side, side, name).where("left_id <> right_id"), name, True)
        out = out.join(best.withColumnRenamed("right_id", f"{name}_nearest"), "left_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    needs = (F.col("token") >= T.TOKEN_THRESHOLD) | (F.col("gram") >= T.GRAM_THRESHOLD)
    return out.select("left_id", F.round("token", 4).alias("token"), "token_nearest", F.round("gram", 4).alias("gram"), "gram_nearest", needs.alias("needs_disposition"))


@query(f"""WITH b AS (SELECT item_id AS id, hash_record AS record, {NORM} AS norm FROM (SELECT *, substr(CAST(item_id AS VARCHAR), 1, length(CAST(item_id AS VARCHAR)) - 1) AS hash_record FROM benchmark)),
t AS (SELECT *, {_WORDS} AS s, {_FILTERED} AS w FROM b WHERE norm <> ''), g AS (SELECT *, {GRAMS} AS g FROM t),
q AS (SELECT x.id AS a, y.id AS b, x.norm AS na, y.norm AS nb, len(list_intersect(x.w, y.w)) AS ow, len(x.w) + len(y.w) AS sw, len(list_intersect(x.g, y.g)) AS og, len(x.g) + len(y.g) AS sg FROM g x JOIN g y ON x.id < y.id AND x.record <> y.record),
p AS (SELECT *, CASE WHEN sw > ow THEN ow / (sw - ow) ELSE 0 END AS tok, CASE WHEN sg > og THEN og / (sg - og) ELSE 0 END AS gram, na <> nb AND least(length(na), length(nb)) >= 20 AND (contains(na, nb) OR contains(nb, na)) AS held FROM q)
SELECT a AS left_id, 'normalized_exact_match' AS kind, b AS right_id, CAST(NULL AS DOUBLE) AS score FROM p WHERE na = nb
UNION ALL SELECT a, 'normalized_containment', b, NULL FROM p WHERE held
UNION ALL SELECT a, 'token_jaccard_threshold', b, round(tok, 6) FROM p WHERE tok >= 0.15 AND na <> nb
UNION ALL SELECT a, 'character_5gram_jaccard_threshold', b, round(gram, 6) FROM p WHERE gram >= 0.10 AND na <> nb""")
def internal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items among themselves, ten to a record."""
    i = F.col("item_id").cast("string")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring(i, F.lit(1), F.length(i) - 1).alias("record"), "text")
    return C.internal_audit(b)


@query(_BASE + """SELECT a AS left_id, 'normalized_exact_match' AS kind, b AS right_id FROM p WHERE na = nb AND a % 3 <> 0 UNION ALL SELECT a, 'normalized_containment', b FROM p WHERE held AND a % 3 <> 0""")
def containment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal or held pairs, but for those that a list permits (here all of every third document)."""
    a, b = _sides(spark, sf_dir)
    permitted = C.screen(a.where("id % 3 = 0"), b, similar=False).select("left_id", "right_id").distinct()
    return C.containment_gate(C.screen(a, b, similar=False), permitted)


@query("SELECT doc_id AS id FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def historical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that an earlier pool doesn't hold yet."""
    d = table(spark, sf_dir, "documents")
    return C.uncovered(d.select(F.col("doc_id").alias("id"), "text"), d.where("doc_id % 2 = 0").select("text"))


_TERMS = r"""(SELECT DISTINCT id, CASE WHEN lower(w) IN ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday') THEN lower(w) ELSE w END AS term FROM
 (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT id, regexp_extract_all(s, '([A-Za-z'']+|\p{{Nd}}+)', 1) AS ws FROM (SELECT {1} AS id, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM {0})))
 WHERE lower(w) IN ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday') OR regexp_matches(w, '^\p{{Nd}}') OR (regexp_matches(w, '^[A-Z]') AND i > 1 AND lower(w) <> 'i'))"""


@query(f"""WITH a AS {_TERMS.format("documents", "doc_id")}, b AS {_TERMS.format("benchmark", "item_id")}
SELECT a.id AS left_id, b.id AS right_id, count(*) AS n_shared FROM a JOIN b ON a.term = b.term GROUP BY ALL HAVING count(*) >= 2""")
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share two names, numbers or days."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.entity_terms(F.col("text")).alias("elements"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.entity_terms(F.col("text")).alias("elements"))
    return C.shared_terms(docs, items)
