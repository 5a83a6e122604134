"""Queries of the membership checks, each with its SQL; they join the catalog when this module is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import membership as M
from .catalog import query, table


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z0-9_-]+$') AS url_safe, regexp_matches(CAST(page_id AS VARCHAR), '^[A-Za-z0-9_-]+$') AS id_safe FROM pages")
def safe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: identifiers that can't leave their folder."""
    return table(spark, sf_dir, "pages").select("page_id", M.safe_identifier(F.col("url")).alias("url_safe"), M.safe_identifier(F.col("page_id").cast("string")).alias("id_safe"))


@query("""WITH w AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'), t AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT DISTINCT o_custkey, CASE WHEN n IS NULL THEN 'not_in_train' ELSE 'repeated' END AS fault FROM w LEFT JOIN t USING (o_custkey) WHERE n IS NULL OR n > 1
UNION ALL SELECT DISTINCT o_custkey, 'in_validation' FROM w WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def membership_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have to be in one arm exactly once and in no other."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return M.membership_faults(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), {"in_validation": o.where("o_orderstatus = 'O'")}, "o_custkey")


@query("""SELECT c_custkey, fault FROM (SELECT c_custkey, CASE WHEN n IS NULL THEN 'unclassified' WHEN n > 1 THEN 'double_classified' END AS fault
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey) WHERE fault IS NOT NULL""")
def classification_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items classified not at all or more than once."""
    return M.classification_faults(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH a AS (SELECT conv_id, turn, sha256(text) AS h FROM conversations), b AS (SELECT conv_id, turn, h FROM a WHERE (conv_id + turn) % 11 <> 0)
SELECT conv_id, count(a.turn) AS n_a, count(b.turn) AS n_b, bool_and(b.turn IS NOT NULL AND a.h IS NOT DISTINCT FROM b.h) AS equal FROM a LEFT JOIN b USING (conv_id, turn) GROUP BY conv_id""")
def split_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hash sequences of each split are equal in two corpora."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("h"))
    return M.split_comparison(a, a.where("(conv_id + turn) % 11 <> 0"), "conv_id", "turn", "h")


@query("""SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY quality DESC, toxic, n_chars DESC, lang, doc_id) AS r
FROM documents JOIN labels USING (doc_id)) WHERE r = 1""")
def best_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of each source by several keys."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return M.best_each(d, "source", [-F.col("quality"), F.col("toxic"), -F.col("n_chars"), F.col("lang"), F.col("doc_id")], ["doc_id", "n_chars"])
