"""Queries of benchmark reports, cues, secrets, fingerprints and eligibility, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..functions import text as T
from ..functions.responses import response_fault
from ..operators import curation as K
from ..operators import governance as G
from ..operators import reports as R
from .catalog import query, table

DIMENSIONS = ["quality", "clean", "length"]

#: Results over labelled documents; every kind of null and miss occurs. A probe's status is that of its document's id.
_RESULTS = """WITH r AS (SELECT doc_id AS id, lang, source, ['regression_guard', 'negative_example', 'acceptance_gate'][CAST(doc_id % 3 AS INTEGER) + 1] AS status, doc_id % 11 <> 0 AS valid,
CASE WHEN doc_id % 7 <> 0 THEN 2 * quality END AS s1, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN n_chars < 3000 THEN 2 ELSE 1 END END AS s2, CASE WHEN doc_id % 35 <> 0 THEN toxic = 0 END AS c1, doc_id % 2 = 0 AS needs
FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, valid AND coalesce(s1, 2) = 2 AND coalesce(s2, 2) = 2 AND coalesce(s1, 0) = 2 AND (NOT needs OR coalesce(s2, 0) = 2) AND coalesce(c1, false) AS pass FROM r)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    i, null = F.col("doc_id"), F.lit(None)
    status = F.element_at(F.array(*map(F.lit, ("regression_guard", "negative_example", "acceptance_gate"))), (i % 3 + 1).cast("int"))
    scores = F.create_map(F.lit("quality"), F.when(i % 7 != 0, 2 * F.col("quality")).otherwise(null), F.lit("length"), F.when(i % 5 != 0, F.when(F.col("n_chars") < 3000, 2).otherwise(1)).otherwise(null))
    checks = F.create_map(F.lit("clean"), F.when(i % 35 != 0, F.col("toxic") == 0).otherwise(null))
    required = F.when(i % 2 == 0, F.array(F.lit("quality"), F.lit("length"))).otherwise(F.array(F.lit("quality")))
    return d.select(i.alias("id"), "lang", "source", status.alias("status"), (i % 11 != 0).alias("valid"), scores.alias("scores"), checks.alias("checks"), required.alias("required"))


def _passes(r: DataFrame) -> Column:
    return K.probe_passes(F.col("valid"), F.col("scores"), R.checked_dimensions(F.col("required"), DIMENSIONS), F.col("checks"))


@query(_RESULTS + " SELECT id, pass FROM p")
def benchmark_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: with invalid formats, null scores and checks, and required dimensions; an unknown dimension raises."""
    r = _results(spark, sf_dir)
    return r.select("id", _passes(r).alias("pass"))


@query(_RESULTS + ", k AS (SELECT id, pass, s1, s2, CASE WHEN id % 4 = 0 AND s2 IS NOT NULL THEN s2 = 2 END AS rule FROM p) SELECT id, pass AND coalesce(rule, true) AS pass FROM k")
def structured_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: integrity first (an inconsistent record raises), then A1 and the count rules."""
    r = _results(spark, sf_dir)
    rule = F.when((F.col("id") % 4 == 0) & F.col("scores")["length"].isNotNull(), F.col("scores")["length"] == 2)
    fault = F.when(F.size("scores") != 2, F.lit("scores"))
    return r.select("id", R.structured_pass(fault, _passes(r), [rule]).alias("pass"))


@query(_RESULTS + """ SELECT id, CASE WHEN id % 13 = 0 THEN 'category' WHEN id % 17 = 0 THEN 'status' WHEN id % 19 = 0 THEN 'capability_checks' END AS fault FROM r WHERE id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0""")
def rubric_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: results whose copied fields differ from the frozen probe, and the first field that does."""
    r, i = _results(spark, sf_dir), F.col("id")
    same = [("category", F.when(i % 13 != 0, F.col("lang")), F.coalesce("lang", F.lit("?"))), ("kind", F.col("source"), F.col("source")), ("status", F.when(i % 17 == 0, "other").otherwise(F.col("status")), F.col("status"))]
    stored = F.when(i % 19 == 0, F.array().cast("array<string>")).otherwise(F.map_keys("checks"))
    return r.select("id", R.binding_fault(same, stored, F.array(F.lit("clean"))).alias("fault")).where("fault is not null")


@query(_RESULTS + " SELECT id, s1 IS NULL AND s2 IS NULL AND c1 IS NULL AS fully FROM r WHERE s1 IS NULL OR s2 IS NULL OR c1 IS NULL")
def unscored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a null among scores or checks, and whether all are."""
    s, c = F.col("scores"), F.col("checks")
    return _results(spark, sf_dir).where(R.has_unscored(s, c)).select("id", R.all_unscored(s, c).alias("fully"))


@query(_RESULTS + " SELECT status, count(*) AS total, count(*) FILTER (pass) AS passed FROM p GROUP BY status")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards, negatives and gates, how many of each and how many pass."""
    r = _results(spark, sf_dir)
    return r.withColumn("pass", _passes(r)).groupBy("status").agg(F.count("*").alias("total"), F.count_if("pass").alias("passed"))


@query(_RESULTS + " SELECT status, id, pass FROM p WHERE pass = (status = 'negative_example')")
def gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results to name: guards and gates that fail, negatives that are resolved. One row each, so of any number."""
    r = _results(spark, sf_dir)
    return r.withColumn("pass", _passes(r)).where(F.col("pass") == (F.col("status") == "negative_example")).select("status", "id", "pass")


@query(_RESULTS + " SELECT id, CASE WHEN s1 IS NULL OR s2 IS NULL OR c1 IS NULL THEN NULL ELSE valid AND s1 = 2 AND s2 = 2 AND c1 END AS strict_pass FROM r")
def strict_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null while anything is unscored; an invalid format fails; a missing dimension raises."""
    two = F.transform_values("scores", lambda _, v: v == 2)
    return _results(spark, sf_dir).select("id", R.strict_pass(F.col("valid"), two, ["quality", "length"], F.col("checks")).alias("strict_pass"))


_SPLIT = r"(?:[.!?;\n]+|[\s\p{Z}]+[—–-][\s\p{Z}]+)"


@query(f"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, ' and ', ' - '), '{_SPLIT}'),
 lambda c: trim(regexp_replace(regexp_replace(lower(c), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))), lambda c: c <> '') AS cs FROM documents)
SELECT doc_id, CAST(len(cs) AS BIGINT) AS n_clauses, sha256(array_to_string(cs, chr(10))) AS clauses_sha256 FROM c""")
def clause_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses, with dashes between some of the words."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clauses(F.replace("text", F.lit(" and "), F.lit(" - "))).alias("cs"))
    return d.select("doc_id", F.size("cs").cast("long").alias("n_clauses"), F.sha2(F.array_join("cs", "\n"), 256).alias("clauses_sha256"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM documents), t AS (SELECT doc_id, regexp_extract_all(s, '([A-Za-z'']+|\p{Nd}+)', 1) AS ws FROM w),
x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
e AS (SELECT DISTINCT doc_id, CASE WHEN lower(w) IN ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday') THEN lower(w) ELSE w END AS term FROM x
 WHERE lower(w) IN ('monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday', 'sunday') OR regexp_matches(w, '^\p{Nd}') OR (regexp_matches(w, '^[A-Z]') AND i > 1 AND lower(w) <> 'i'))
SELECT doc_id, count(term) AS n_terms, sha256(coalesce(string_agg(term, ' ' ORDER BY term), '')) AS terms_sha256 FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id""")
def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, numbers and days of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.entity_terms(F.col("text")), F.array().cast("array<string>")).alias("ts"))
    return d.select("doc_id", F.size("ts").cast("long").alias("n_terms"), F.sha2(F.array_join("ts", " "), 256).alias("terms_sha256"))


def _cue_sql(name: str) -> str:
    pattern = T.CUES[name].replace("<", r"(?:^|[^\p{L}\p{N}_])").replace(">", r"(?:$|[^\p{L}\p{N}_])").replace("'", "''")
    return f"coalesce(regexp_matches(text, '(?i){pattern}'), false) AS {name}"


@query(f"SELECT doc_id, {', '.join(map(_cue_sql, T.CUES))} FROM documents")
def cue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question, tentative, time, destination and quantity cues."""
    return table(spark, sf_dir, "documents").select("doc_id", *(T.cue(F.col("text"), n).alias(n) for n in T.CUES))


_SECRETS = "SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' AIza' || repeat('x', 24) WHEN 1 THEN ' Bearer abc.def==' WHEN 2 THEN ' bearer [REDACTED]' ELSE '' END AS t FROM documents"


@query(f"""WITH s AS ({_SECRETS}) SELECT doc_id, coalesce(regexp_matches(t, 'AIza[0-9A-Za-z_-]{{20,}}') OR regexp_matches(replace(lower(t), 'bearer [redacted]', ''), 'bearer\\s+\\S+'), false) AS secret,
sha256(regexp_replace(regexp_replace(t, '(?i)bearer\\s+[A-Za-z0-9._~+\\-/]+=*', 'Bearer [REDACTED]', 'g'), 'AIza[0-9A-Za-z_-]{{20,}}', '[REDACTED]', 'g')) AS redacted_sha256 FROM s""")
def secret_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T18 and T19 for values, with keys and bearer tokens planted in half of the rows."""
    i = F.col("doc_id") % 4
    planted = F.when(i == 0, F.concat(F.lit(" AIza"), F.repeat(F.lit("x"), 24))).when(i == 1, " Bearer abc.def==").when(i == 2, " bearer [REDACTED]").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", planted).alias("t"))
    return d.select("doc_id", T.contains_secret(F.col("t")).alias("secret"), F.sha2(T.redact_secrets(F.col("t")), 256).alias("redacted_sha256"))


@query("""SELECT doc_id, sha256('{"input":' || to_json(text) || '}') AS source_fingerprint, sha256('{"input":' || to_json(text) || ',"output":{"lang":' || to_json(lang) || ',"n_chars":' || n_chars || '}}') AS pair_fingerprint,
sha256('{"id":' || doc_id || ',"kind":"document","lang":' || to_json(lang) || '}') AS artifact_fingerprint FROM documents""")
def record_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints of a source, a pair and an artifact, whose own fingerprint is left out."""
    text, lang, number = J.json_string(F.col("text")), J.json_string(F.col("lang")), F.col("n_chars").cast("string")
    artifact = {"kind": F.lit('"document"'), "id": F.col("doc_id").cast("string"), "lang": lang, "artifact_fingerprint": F.lit("null")}
    pair = {"input": text, "output": J.json_object({"lang": lang, "n_chars": number})}
    return table(spark, sf_dir, "documents").select("doc_id", J.fingerprint({"input": text}).alias("source_fingerprint"), J.fingerprint(pair).alias("pair_fingerprint"), J.fingerprint(artifact, "artifact_fingerprint").alias("artifact_fingerprint"))


@query("""WITH e AS (SELECT item_id AS id, '{"pair_fingerprint":"sha256:' || sha256(text) || '","record_id":' || to_json(CAST(item_id AS VARCHAR)) || ',"rubric_fingerprint":"sha256:' || sha256(CAST(item_id AS VARCHAR)) || '","source_fingerprint":"sha256:' || sha256('{"input":' || to_json(text) || '}') || '"}' AS j FROM benchmark)
SELECT sha256('{"records":[' || string_agg(j, ',' ORDER BY CAST(id AS VARCHAR)) || '],"rubric_schema_version":1,"split":"real_validation"}') AS dataset_fingerprint, count(*) AS n FROM e""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fingerprint of a curated set, its records sorted by id. The set is a benchmark: at most a million rows, else it raises."""
    i = F.col("item_id").cast("string")
    sha = lambda c: F.concat(F.lit('"'), J.prefixed(F.sha2(c, 256)), F.lit('"'))
    source = sha(J.json_object({"input": J.json_string(F.col("text"))}))
    entry = J.json_object({"record_id": J.json_string(i), "source_fingerprint": source, "pair_fingerprint": sha(F.col("text")), "rubric_fingerprint": sha(i)})
    return _one_fingerprint(table(spark, sf_dir, "benchmark").select(i.alias("id"), entry.alias("entry")), lambda rows: J.json_object({"rubric_schema_version": F.lit("1"), "split": F.lit('"real_validation"'), "records": rows}), "dataset_fingerprint")


@query("""SELECT sha256('[' || string_agg('{"prompt":' || to_json(text) || ',"target":' || to_json(CAST(item_id AS VARCHAR)) || '}', ',' ORDER BY text, CAST(item_id AS VARCHAR)) || ']') AS training_fingerprint, count(*) AS n FROM benchmark""")
def training_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one fingerprint of all pairs sorted by prompt, then by target; bounded like dataset_fingerprint."""
    pair = J.json_object({"prompt": J.json_string(F.col("text")), "target": J.json_string(F.col("item_id").cast("string"))})
    order = F.struct("text", F.col("item_id").cast("string"))
    return _one_fingerprint(table(spark, sf_dir, "benchmark").select(order.alias("id"), pair.alias("entry")), lambda rows: rows, "training_fingerprint")


@query("""SELECT CASE WHEN item_id % 3 = 0 THEN 'val' ELSE 'train' END AS arm, count(*) AS n, sha256('[' || string_agg('{"prompt":' || to_json(text) || ',"target":' || to_json(CAST(item_id AS VARCHAR)) || '}', ',' ORDER BY text, CAST(item_id AS VARCHAR)) || ']') AS fingerprint FROM benchmark GROUP BY 1""")
def arm_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and data fingerprint of each arm of a curated set, bounded like dataset_fingerprint."""
    pair = J.json_object({"prompt": J.json_string(F.col("text")), "target": J.json_string(F.col("item_id").cast("string"))})
    b = table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 3 == 0, "val").otherwise("train").alias("arm"), F.struct(F.col("text"), F.col("item_id").cast("string").alias("id"), pair.alias("entry")).alias("e"))
    rows = b.limit(1_000_001).groupBy("arm").agg(F.array_sort(F.collect_list("e")).alias("r"))
    bounded = F.when(F.size("r") > 1_000_000, F.raise_error(F.lit("more than 1000000 records"))).otherwise(F.col("r")["entry"])
    return rows.select("arm", F.size("r").cast("long").alias("n"), F.sha2(J.json_array(bounded), 256).alias("fingerprint"))


def _one_fingerprint(entries: DataFrame, whole, name: str, most: int = 1_000_000) -> DataFrame:
    rows = entries.limit(most + 1).agg(F.array_sort(F.collect_list(F.struct("id", "entry"))).alias("r"))
    bounded = F.when(F.size("r") > most, F.raise_error(F.lit(f"more than {most} records"))).otherwise(F.col("r")["entry"])
    return rows.select(F.sha2(whole(J.json_array(bounded)), 256).alias(name), F.size("r").cast("long").alias("n"))


_ENTRY = """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'withdrawn' ELSE 'active' END AS w, CASE WHEN doc_id % 23 <> 0 THEN doc_id % 21 <> 0 END AS confirmed, CASE WHEN toxic = 1 THEN 'pending' ELSE 'approved' END AS d,
CASE WHEN quality = 1 THEN 'adjudicated' ELSE 'draft' END AS a, CASE WHEN lang = 'en' THEN 'real_holdout' ELSE 'real_validation' END AS split, doc_id % 31 = 0 AS no_uses, doc_id % 37 = 0 AS training, doc_id % 41 <> 0 AS annotation, CASE WHEN doc_id % 43 <> 0 THEN true END AS evaluation, doc_id % 2 = 0 AS holdout FROM labels JOIN documents USING (doc_id))"""


@query(_ENTRY + """ SELECT doc_id, CASE WHEN w <> 'active' THEN 'withdrawal_status' WHEN confirmed IS DISTINCT FROM true THEN 'author_confirmed' WHEN d <> 'approved' THEN 'deidentification_status' WHEN a <> 'adjudicated' THEN 'annotation_status'
WHEN split <> 'real_holdout' THEN 'split' WHEN no_uses THEN 'allowed_uses' WHEN training THEN 'training_or_publication' WHEN NOT annotation THEN 'private_annotation' WHEN evaluation IS DISTINCT FROM true THEN 'private_evaluation' WHEN NOT holdout THEN 'holdout_eligible' END AS reason FROM e""")
def split_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the first of the ten conditions, in order, that keeps an entry out of the holdout split."""
    i = F.col("doc_id")
    uses = F.when(i % 31 != 0, F.struct((i % 37 == 0).alias("training"), F.lit(False).alias("publication"), (i % 41 != 0).alias("annotation"), F.when(i % 43 != 0, True).alias("evaluation"), (i % 2 == 0).alias("holdout")))
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    e = d.select("doc_id", F.when(i % 29 == 0, "withdrawn").otherwise("active").alias("w"), F.when(i % 23 != 0, i % 21 != 0).alias("confirmed"), F.when(F.col("toxic") == 1, "pending").otherwise("approved").alias("d"), F.when(F.col("quality") == 1, "adjudicated").otherwise("draft").alias("a"), F.when(F.col("lang") == "en", "real_holdout").otherwise("real_validation").alias("split"), uses.alias("uses"))
    return e.select("doc_id", G.first_failure(G.split_conditions("real_holdout")).alias("reason"))


@query(r"""WITH t AS (SELECT doc_id, replace(array_to_string((string_split(replace(text, chr(10), ' '), ' '))[1:300], ' '), chr(9), ' ') AS s, substr(replace(replace(text, chr(10), ' '), chr(9), ' '), 1, 200) AS n FROM documents),
c AS (SELECT *, len(regexp_extract_all(s, '[''-]*[\p{L}\p{N}_][\p{L}\p{N}_''-]*')) AS words, len(regexp_extract_all(n, '[^.!?]+[.!?](?:\s|$)')) AS sentences FROM t)
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'response_json_invalid' WHEN doc_id % 19 = 0 THEN 'top_level_keys_invalid' WHEN trim(s) = '' OR regexp_matches(s, '[\x00-\x1f\x7f]') THEN 'source_input_not_plain_string' WHEN words NOT BETWEEN 80 AND 220 THEN 'source_input_word_count_out_of_range'
WHEN doc_id % 23 = 0 THEN 'proposed_output_keys_invalid' WHEN trim(n) = '' THEN 'narrative_not_plain_string' WHEN sentences NOT BETWEEN 1 AND 4 THEN 'narrative_sentence_count_out_of_range'
WHEN doc_id % 10 NOT BETWEEN 2 AND 8 THEN 'list_item_count_out_of_range' WHEN doc_id % 8 NOT BETWEEN 1 AND 6 THEN 'list_item_count_out_of_range' END AS fault FROM c""")
def candidate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: responses made of the documents' words, some with faults of form."""
    i, flat = F.col("doc_id"), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    source = F.array_join(F.slice(F.split(flat, " "), 1, 300), " ")
    items = lambda n: J.json_array(F.array_repeat(F.lit('"x"'), n.cast("int")))
    output = {"narrative": J.json_string(F.substring(flat, 1, 200)), "bullets": items(i % 10), "action_items": items(i % 8)}
    nested = F.when(i % 23 == 0, F.lit("{}")).otherwise(J.json_object(output))
    good = J.json_object({"source_input": J.json_string(source), "proposed_output": nested})
    raw = F.when(i % 17 == 0, F.lit("{")).when(i % 19 == 0, F.lit('{"source_input":"x"}')).otherwise(good)
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", response_fault(F.col("raw")).alias("fault"))
