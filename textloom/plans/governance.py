"""Queries of the governance checks, each with its SQL; they join the catalog when this module is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as G
from ..functions import text as T
from ..operators import curation as K
from .catalog import _RECORDS, NORM, _records, query, table

FP = "sha256(text)"


@query(f"SELECT doc_id, n_sharing FROM (SELECT doc_id, count(*) OVER (PARTITION BY {FP}) AS n_sharing FROM documents WHERE text IS NOT NULL) WHERE n_sharing > 1")
def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4 in part (not the pilot's rule on holdout records): records that share a source fingerprint."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fp"))
    return G.shared_fingerprints(d, "fp").select("doc_id", "n_sharing")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN coalesce(trim(text), '') = '' THEN 'blank' WHEN lang IS DISTINCT FROM 'en' THEN 'language' WHEN toxic IS DISTINCT FROM 0 THEN 'toxic'
WHEN quality IS DISTINCT FROM 1 THEN 'quality' END AS reason FROM documents LEFT JOIN (SELECT * FROM labels) l USING (doc_id)""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the first condition, in order, that keeps a record out of a split."""
    j = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    conditions = [("no_label", F.col("labelled")), ("blank", F.trim("text") != ""), ("language", F.col("lang") == "en"), ("toxic", F.col("toxic") == 0), ("quality", F.col("quality") == 1)]
    return j.select("doc_id", G.first_failure(conditions).alias("reason"))


@query("""SELECT o_orderkey, o_custkey, n_nationkey, CASE WHEN c_custkey IS NULL THEN 'no_manifest_entry' WHEN n_nationkey IS NULL THEN 'no_rubric' ELSE 'ok' END AS link
FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey""")
def record_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to manifest entries to rubrics, what is missing named."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("fp"))
    manifest = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("fp"), F.col("c_nationkey").alias("record"))
    rubrics = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("record"), "n_nationkey")
    return G.linked(rows, manifest, rubrics, "fp", "record").select("o_orderkey", F.col("fp").alias("o_custkey"), "n_nationkey", "link")


REJ = "(SELECT user_id AS k, count(*) AS a FROM events WHERE event_type = 'purchase' GROUP BY 1)"
DIAG = "(SELECT c_custkey AS k, count(*) AS b FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1)"


@query(f"""SELECT k AS user_id, fault FROM (SELECT k, CASE WHEN b IS NULL THEN 'unlinked_rejection' WHEN a IS NULL THEN 'unlinked_diagnostic' WHEN a > 1 OR b > 1 THEN 'repeated' END AS fault
FROM {REJ} FULL JOIN {DIAG} USING (k)) WHERE fault IS NOT NULL""")
def rejection_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that aren't linked one to one."""
    a = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id")
    b = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    return G.link_faults(a, b, "user_id")


@query("""SELECT doc_id, fault FROM (SELECT doc_id, CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN p.doc_id IS NULL THEN 'extra' WHEN s.q IS NOT NULL THEN 'scored' END AS fault
FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) p FULL JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN quality END AS q FROM labels) s USING (doc_id)) WHERE fault IS NOT NULL""")
def scaffold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unscored scaffold has the probes' ids and no score."""
    scaffold = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.col("quality")).alias("q"))
    return G.scaffold_faults(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id"), scaffold, "doc_id", ["q"])


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality = 1 AND toxic = 0 ELSE NOT (quality = 1 AND toxic = 0) END AS valid FROM labels""")
def review_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that fit their dimensions."""
    verdict = F.when(F.col("doc_id") % 2 == 0, "accept").otherwise("reject")
    dims = F.create_map(F.lit("faithful"), F.col("quality") == 1, F.lit("safe"), F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select("doc_id", G.coherent_verdict(verdict, dims).alias("valid"))


@query("""SELECT doc_id, fault FROM (SELECT doc_id, CASE WHEN s.doc_id IS NULL THEN 'no_source' WHEN r.text IS DISTINCT FROM s.text OR r.lang IS DISTINCT FROM s.lang THEN 'altered' END AS fault
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' ' ELSE text END AS text, lang FROM documents) r LEFT JOIN (SELECT doc_id, text, lang FROM documents WHERE doc_id % 11 <> 0) s USING (doc_id)) WHERE fault IS NOT NULL""")
def reuse_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reused rows must equal their source rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    reused = d.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return G.altered_reuse(reused, d.where("doc_id % 11 <> 0"), "doc_id", ["text", "lang"])


@query("""WITH base AS (SELECT n_nationkey AS i, n_name AS v FROM nation), delta AS (SELECT r_regionkey AS i, r_name AS v FROM region), want AS (SELECT i, v FROM base UNION ALL SELECT i + (SELECT count(*) FROM base), v FROM delta),
got AS (SELECT i, CASE WHEN i % 6 = 5 THEN lower(v) ELSE v END AS v FROM want WHERE i % 13 <> 4) SELECT i AS ordinal, fault FROM (SELECT i, CASE WHEN g.i IS NULL THEN 'missing' WHEN g.v <> w.v THEN 'different' END AS fault FROM want w LEFT JOIN got g USING (i)) WHERE fault IS NOT NULL""")
def base_plus_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, J14, O1 on two small tables: a candidate is the base and then the delta, in order; corpus_base_plus_delta takes a corpus."""
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("v"))
    delta = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("v"))
    made = base.union(delta.withColumn("ordinal", F.col("ordinal") + base.count())).where("ordinal % 13 <> 4")
    made = made.withColumn("v", F.when(F.col("ordinal") % 6 == 5, F.lower("v")).otherwise(F.col("v")))
    return G.sequence_faults(made, base, delta, "ordinal", "v")


@query("""SELECT doc_id, CASE WHEN b.p IS NULL THEN 'only_a' WHEN a.p IS NULL THEN 'only_b' WHEN a.p = b.p THEN 'same' WHEN b.p THEN 'fixed' ELSE 'broken' END AS change
FROM (SELECT doc_id, quality = 1 AS p FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, quality = 1 AND toxic = 0 OR doc_id % 8 = 0 AS p FROM labels WHERE doc_id % 7 <> 0) b USING (doc_id)""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24 in part (no strict rate, failures by dimension, format validity or coverage): each record's change between two runs."""
    d = table(spark, sf_dir, "labels")
    a = d.where("doc_id % 5 <> 0").select("doc_id", (F.col("quality") == 1).alias("p"))
    return G.compare_runs(a, d.where("doc_id % 7 <> 0").selectExpr("doc_id", "quality = 1 and toxic = 0 or doc_id % 8 = 0 as p"), "doc_id", "p")


@query("""SELECT event_type, count(*) FILTER (user_id % 4 = 0) AS n_val, count(*) FILTER (user_id % 4 <> 0) AS n_train, count(*) AS n_all, count(*) * (count(*) - 1) // 2 AS n_pairs,
round(CAST(count(*) FILTER (value > 50) AS DOUBLE) / count(*), 6) AS positive_rate, CAST(count(*) FILTER (value > 50) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS passed, count(*) <= 3000 AS below_ceiling FROM events GROUP BY event_type""")
def arm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with and without validation, ordered pairs, rate, count string and ceiling of each kind."""
    n, high = F.count("*"), F.count_if(F.col("value") > 50)
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 4 == 0).alias("n_val"), n.alias("n_all"), high.alias("high"))
    text = F.concat_ws("/", F.col("high").cast("string"), F.col("n_all").cast("string"))
    pairs = F.expr("n_all * (n_all - 1) div 2")
    return counted.select("event_type", "n_val", (F.col("n_all") - F.col("n_val")).alias("n_train"), "n_all", pairs.alias("n_pairs"), F.round(F.col("high") / F.col("n_all"), 6).alias("positive_rate"), text.alias("passed"), (F.col("n_all") <= 3000).alias("below_ceiling"))


@query("""SELECT 'blank' AS kind, count(*) AS n FROM documents WHERE coalesce(trim(text), '') = '' UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'toxic', count(*) FROM labels WHERE toxic = 1""")
def audit_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return G.roll_up([("blank", d.where("coalesce(trim(text), '') = ''")), ("unlabelled", d.join(labels, "doc_id", "left_anti")), ("toxic", labels.where("toxic = 1"))])


@query("SELECT doc_id, text LIKE 'The %' AS exemplar FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def active_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records, whether they begin as an exemplar does."""
    active = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").join(active, "doc_id").select("doc_id", F.col("text").startswith("The ").alias("exemplar"))


@query("""WITH o AS (SELECT sha256(text) AS h, doc_id AS pos, lang FROM documents WHERE doc_id % 97 <> 0 AND text IS NOT NULL), w AS (SELECT sha256(text) AS h, CASE WHEN doc_id % 50 = 1 THEN doc_id + 5 ELSE doc_id END AS pos, CASE WHEN doc_id % 31 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 89 <> 0 AND text IS NOT NULL),
a AS (SELECT h, count(*) AS n, min(pos) AS pos, min(lang) AS lang FROM o GROUP BY h), b AS (SELECT h, count(*) AS n, min(pos) AS pos, min(lang) AS lang FROM w GROUP BY h),
j AS (SELECT h, a.pos AS x, b.pos AS y, CASE WHEN a.n > 1 OR b.n > 1 THEN 'repeated' WHEN b.n IS NULL THEN 'only_old' WHEN a.n IS NULL THEN 'only_new' WHEN a.lang IS DISTINCT FROM b.lang THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (h)),
p AS (SELECT h, row_number() OVER (ORDER BY x, h) <> row_number() OVER (ORDER BY y, h) AS moved FROM j WHERE change IN ('changed', 'same'))
SELECT h AS input_sha256, change, coalesce(moved, false) AS moved FROM j LEFT JOIN p USING (h)""")
def corpus_order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus against another by input hash, with identity, content and order."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("input_sha256"), "lang")
    new = d.where("doc_id % 89 <> 0").selectExpr("input_sha256", "case when doc_id % 50 = 1 then doc_id + 5 else doc_id end as at", "case when doc_id % 31 = 0 then 'xx' else lang end as lang")
    return G.ordered_diff(d.where("doc_id % 97 <> 0").withColumnRenamed("doc_id", "at"), new, "input_sha256", "at", ["lang"])


@query("""WITH c AS (SELECT doc_id, doc_id % 6 = 0 AS l, doc_id % 20 = 0 AS s FROM documents), a AS (SELECT doc_id, doc_id % 12 = 0 OR doc_id % 35 = 0 AS ok FROM documents)
SELECT doc_id, CASE WHEN (l OR s) AND NOT ok THEN 'unexpected' WHEN ok AND NOT (l OR s) THEN 'not_changed' ELSE 'forbidden_fields' END AS fault FROM c JOIN a USING (doc_id) WHERE (l OR s) <> ok OR (ok AND s)""")
def change_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed records are the allow-list's, and only allowed fields changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    new = d.selectExpr("doc_id", "if(doc_id % 6 = 0, lang || '+', lang) as lang", "if(doc_id % 20 = 0, source || '+', source) as source")
    return G.unauthorized(K.diff(d, new, "doc_id", ["lang", "source"]), d.where("doc_id % 12 = 0 or doc_id % 35 = 0"), "doc_id", ["lang"])


@query("SELECT doc_id, CASE WHEN l.i IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT doc_id, doc_id AS i FROM documents WHERE doc_id % 10 <> 3) d FULL JOIN (SELECT doc_id, doc_id AS i FROM labels) l USING (doc_id) WHERE d.i IS NULL OR l.i IS NULL")
def id_set_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without a result and results without an id; none means that the sets are equal."""
    return G.unmatched_ids(table(spark, sf_dir, "documents").where("doc_id % 10 <> 3"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT count(*) AS n, sha256(string_agg(norm, chr(10) ORDER BY norm)) AS content_sha256 FROM (SELECT {NORM} AS norm FROM documents)")
def pool_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row over all sources, beside pool_fingerprint's row for each."""
    n, digest = G.sorted_content(table(spark, sf_dir, "documents").select(T.normalize(F.col("text")).alias("norm")), "norm")
    return spark.createDataFrame([(n, digest)], "n long, content_sha256 string")


@query(_RECORDS + """ SELECT conv_id, list_filter([CASE WHEN trim(coalesce(narrative, '')) = '' THEN 'narrative_missing_or_blank' END, CASE WHEN list_contains(bullets, '') THEN 'bullets_malformed_or_contains_blank' END,
CASE WHEN NOT list_contains(bullets, '') AND len(bullets) > 7 THEN 'bullets_exceeds_dataset_spec_max_7' END, CASE WHEN NOT list_contains(bullets, '') AND len(bullets) NOT BETWEEN 2 AND 8 THEN 'bullets_outside_gemini_schema_bounds_2_to_8' END,
CASE WHEN list_contains(actions, '') THEN 'action_items_malformed_or_contains_blank' END, CASE WHEN len(actions) = 0 THEN 'action_items_empty_conflicts_with_gemini_schema_minitems_1' END,
CASE WHEN NOT list_contains(actions, '') AND len(actions) > 6 THEN 'action_items_exceeds_gemini_schema_max_6' END], lambda x: x IS NOT NULL) AS findings FROM r""")
def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of both contracts and blank items, all findings of a record; keys are fixed by the columns here."""
    b, a = F.col("bullets"), F.col("actions")
    clean = lambda x: ~F.array_contains(x, "")
    rules = [
        ("narrative_missing_or_blank", F.trim("narrative") != ""),
        ("bullets_malformed_or_contains_blank", clean(b)),
        ("bullets_exceeds_dataset_spec_max_7", ~clean(b) | (F.size(b) <= 7)),
        ("bullets_outside_gemini_schema_bounds_2_to_8", ~clean(b) | F.size(b).between(2, 8)),
        ("action_items_malformed_or_contains_blank", clean(a)),
        ("action_items_empty_conflicts_with_gemini_schema_minitems_1", F.size(a) > 0),
        ("action_items_exceeds_gemini_schema_max_6", ~clean(a) | (F.size(a) <= 6)),
    ]
    return _records(spark, sf_dir).select("conv_id", K.violations(rules).alias("findings"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text FROM documents WHERE doc_id % 4 <> 0), d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text FROM documents WHERE doc_id % 4 = 0),
want AS (SELECT i, text FROM b UNION ALL SELECT i + (SELECT count(*) FROM b), text FROM d) SELECT i AS ordinal, CASE WHEN i % 13 = 4 THEN 'missing' ELSE 'different' END AS fault FROM want WHERE i % 13 = 4 OR (i % 6 = 5 AND text IS NOT NULL)""")
def corpus_base_plus_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole candidate corpus is the base and then the delta, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("v"))
    base, delta = (G.numbered(d.where(x), ["doc_id"], "ordinal") for x in ("doc_id % 4 <> 0", "doc_id % 4 = 0"))
    made = base.union(delta.withColumn("ordinal", F.col("ordinal") + base.count())).where("ordinal % 13 <> 4")
    made = made.withColumn("v", F.when(F.col("ordinal") % 6 == 5, F.concat("v", F.lit("+"))).otherwise(F.col("v")))
    return G.sequence_faults(made, base, delta, "ordinal", "v")
