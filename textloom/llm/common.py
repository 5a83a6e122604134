"""Tables in the shared folder, size checks and graph components, used by the operators here."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id in internal keys: it sorts after every real id.
NULL_ID = 2**63 - 1

_own_dir: list[str] = []


def id_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def text_hash() -> Column:
    """Tells rows of one doc_id, or without one, apart by their text."""
    return F.xxhash64("text")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has; Spark takes names that differ in case only as one."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        name = f"__{n}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or an own one in local mode if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base if "://" in base or base.startswith("file:") else f"file://{base}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="textloom-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/textloom/{uuid.uuid4().hex}/{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back: lineage is cut, lost executors cost no rework."""
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # a written table needs its shuffle files no longer
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by min-neighbour contraction.

    ``edges`` has long columns ``a`` and ``b``. Returns ``v``, ``component`` (the smallest vertex reachable) for
    every vertex that has an edge to another one. Each round maps every vertex to the smallest of its closed
    neighbourhood and contracts the edges, so the edge table shrinks; both tables are written in each round.
    """
    live = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = materialize(spark, live, "edges")
    labels = materialize(spark, live.select(F.col("a").alias("v")).union(live.select("b")).distinct().withColumn("component", F.col("v")), "labels")
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = materialize(spark, low, "lowest")
        ma, mb = low.toDF("a", "ma"), low.toDF("b", "mb")
        new = live.join(ma, "a").join(mb, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        old_live, old_labels = live, labels
        labels = labels.join(low.toDF("component", "m"), "component", "left").select("v", F.coalesce("m", "component").alias("component"))
        labels = materialize(spark, labels, "labels")
        live = materialize(spark, new, "edges")
        for old in (old_live, old_labels, low):
            drop_path(spark, old.table_path)
    return labels


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Collects a small table, refusing one that is larger than the stated bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; TOKENIZER_DIR overrides the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
