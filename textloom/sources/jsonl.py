"""Strict JSON-lines sources with line numbers, pinned files, artifacts and sinks.

Curated files are small: each is read whole by one task, which is what gives line numbers and hashes of whole files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "file string, line long, raw string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and raw of every line, blank ones included; a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], RAW)
    whole = spark.read.text(path, wholetext=True)
    split = whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "raw"))
    return split.select("file", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"))


def fault(raw: Column, strict: bool) -> Column:
    """Why a line isn't a JSON object; ``strict`` also refuses duplicate keys at any depth, of which a lenient reader takes the last."""
    parsed = F.get_json_object(raw, "$")
    broken = F.when(parsed.isNull(), F.lit("invalid JSON")).when(~raw.startswith("{"), F.lit("not an object"))
    return F.coalesce(broken, F.when(F.try_parse_json(raw).isNull(), F.lit("duplicate key"))) if strict else broken


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """file, line, record, error of every line that isn't blank. A missing file has no rows."""
    some = lines(spark, path).where("raw <> ''")
    error = fault(F.col("raw"), strict)
    return some.select("file", "line", F.when(error.isNull(), F.from_json("raw", schema)).alias("record"), error.alias("error"))


def refuse(found: DataFrame) -> DataFrame:
    """``found`` without error; raises, when run, at a row that has one, naming file and line."""
    where = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "error")
    return found.where(F.when(F.col("error").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(True)).drop("error")


def read_manifest(spark: SparkSession, path: str, schema: str, key: str = "record_id") -> DataFrame:
    """file, line, record, error of every line: blank lines, missing keys and later rows of a key are errors too."""
    every = lines(spark, path)
    last = every.groupBy("file").agg(F.max("line").alias("line"))
    rest = every.join(last.withColumn("last", F.lit(True)), ["file", "line"], "left").where("last is null or raw <> ''")  # what follows the final newline
    error = F.when(F.col("raw") == "", F.lit("blank line")).otherwise(fault(F.col("raw"), True))
    rows = rest.select("file", "line", F.when(error.isNull(), F.from_json("raw", schema)).alias("record"), error.alias("error"))
    first = rows.where("error is null").groupBy("file", F.col(f"record.{key}").alias("k")).agg(F.min("line").alias("first"))
    rows = rows.withColumn("k", F.col(f"record.{key}")).join(first, ["file", "k"], "left")
    more = F.when(F.coalesce("k", F.lit("")) == "", F.lit(f"missing {key}")).when(F.col("line") > F.col("first"), F.lit(f"duplicate {key}"))
    return rows.select("file", "line", "record", F.coalesce("error", more).alias("error"))


def read_pinned(spark: SparkSession, path: str, expected_sha256: str | None = None, expected_rows: int | None = None) -> DataFrame:
    """path, content_sha256 (of LF bytes), byte_sha256, endings, rows, error of every file.

    Refused are a BOM, a missing final newline, bare CR, mixed endings, bytes that aren't UTF-8, and another hash or number of rows than expected. An empty file
    has no row.
    """
    text = F.decode("content", "ISO-8859-1")
    hx = F.hex("content")
    lf, cr, both = (F.regexp_count(text, F.lit(x)) for x in ("\n", "\r", "\r\n"))
    canonical = F.encode(F.replace(text, F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    error = F.when(hx.startswith("EFBBBF"), "bom").when(~F.coalesce(hx.endswith("0A"), F.lit(False)), "no_final_newline").when(cr != both, "bare_cr").when((both > 0) & (both != lf), "mixed_endings")
    error = error.when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
    if expected_sha256:
        error = error.when(F.sha2(canonical, 256) != expected_sha256.removeprefix("sha256:"), "hash_mismatch")
    if expected_rows is not None:
        error = error.when(lf != expected_rows, "row_count")
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.sha2(canonical, 256).alias("content_sha256"), F.sha2("content", 256).alias("byte_sha256"), F.when(both > 0, "crlf").otherwise("lf").alias("endings"), lf.cast("long").alias("rows"), error.alias("error"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a file that is one JSON array."""
    return spark.read.schema(T.StructType.fromDDL(schema)).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def write_sorted(df: DataFrame, key: str, path: str) -> None:
    """JSON lines in key order, nulls written, in place of what was there once all is written: by Spark's commit into a folder beside, and a rename."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, beside = hadoop.Path(path), hadoop.Path(f"{path}.new")
    df.orderBy(key).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(beside, target):
        raise OSError(f"{path}: not renamed")


def write_exclusive(df: DataFrame, path: str) -> None:
    """Fails if the path exists."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def refuse_existing(spark: SparkSession, paths: list[str]) -> None:
    """Raises if any output path exists; all are looked at before anything is written."""
    if found := [p for p in paths if exists(spark, p)]:
        raise FileExistsError(", ".join(found))


def label_lines(spark: SparkSession, pinned: dict[str, tuple[str, str, int]]) -> DataFrame:
    """label, file, line, raw of pinned corpora by label (path, hash, rows); raises at the first that isn't as pinned."""
    out = None
    for label, (path, sha256, rows) in pinned.items():
        checked = read_pinned(spark, path, sha256, rows).select("error").collect()  # a row a file
        if bad := [r.error for r in checked if r.error] or (not checked and ["empty"]):
            raise ValueError(f"{label}: {bad[0]}")
        one = lines(spark, path).where("raw <> ''").select(F.lit(label).alias("label"), "file", "line", "raw")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "label string, " + RAW)


