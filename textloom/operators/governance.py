"""Linkage, provenance, eligibility and comparison checks over governed tables. Every check is a join or an aggregate; none gathers a table, only sorted_content() reads one through the driver, a partition at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX = "^sha256:"


def same_fingerprint(a: Column, b: Column) -> Column:
    """Equal with or without the prefix; nulls are equal to nulls only."""
    return F.regexp_replace(a, PREFIX, "").eqNullSafe(F.regexp_replace(b, PREFIX, ""))


def shared_fingerprints(rows: DataFrame, fingerprint: str) -> DataFrame:
    """``rows`` whose fingerprint another row has too, whatever its status, with n_sharing. Null fingerprints are shared with none."""
    shared = rows.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.count("*").alias("n_sharing")).where("n_sharing > 1")
    return rows.join(shared, fingerprint)


def first_failure(conditions: list[tuple[str, Column]]) -> Column:
    """Name of the first condition in order that doesn't hold (unknown counts as not), or null."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in conditions))


def linked(rows: DataFrame, manifest: DataFrame, rubrics: DataFrame, fingerprint: str, record: str) -> DataFrame:
    """``rows`` with the manifest entry of their fingerprint, that entry's rubric, and link: ok, no_manifest_entry or no_rubric."""
    one = rows.join(manifest.withColumn("__m", F.lit(True)), fingerprint, "left").join(rubrics.withColumn("__r", F.lit(True)), record, "left")
    return one.withColumn("link", F.when(F.col("__m").isNull(), "no_manifest_entry").when(F.col("__r").isNull(), "no_rubric").otherwise("ok")).drop("__m", "__r")


def link_faults(rejections: DataFrame, diagnostics: DataFrame, key: str) -> DataFrame:
    """key, fault of every key that isn't linked one to one: unlinked_rejection, unlinked_diagnostic or repeated."""
    a = rejections.groupBy(key).agg(F.count("*").alias("__a"))
    b = diagnostics.groupBy(key).agg(F.count("*").alias("__b"))
    fault = F.when(F.col("__b").isNull(), "unlinked_rejection").when(F.col("__a").isNull(), "unlinked_diagnostic").when((F.col("__a") > 1) | (F.col("__b") > 1), "repeated")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault is not null")


def scaffold_faults(probes: DataFrame, scaffold: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """key, fault of an unscored scaffold: missing, extra, or scored where a score isn't null."""
    b = scaffold.select(key, F.greatest(*(F.col(s).isNotNull().cast("int") for s in scores), F.lit(0)).alias("__scored"))
    j = probes.select(key, F.lit(True).alias("__p")).join(b, key, "full")
    fault = F.when(F.col("__scored").isNull(), "missing").when(F.col("__p").isNull(), "extra").when(F.col("__scored") == 1, "scored")
    return j.select(key, fault.alias("fault")).where("fault is not null")


def coherent_verdict(verdict: Column, dimensions: Column) -> Column:
    """A known verdict with all dimensions scored; acceptance needs all of them passed, rejection one that isn't."""
    v = F.map_values(dimensions)
    scored = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
    passed = F.forall(v, lambda x: F.coalesce(x, F.lit(False)))
    return F.coalesce(scored & F.when(verdict == "accept", passed).when(verdict == "reject", ~passed).otherwise(False), F.lit(False))


def altered_reuse(reused: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fault of reused rows that aren't their source row's equal in every field: no_source or altered."""
    s = source.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__s"))
    equal = F.lit(True)
    for f in fields:
        equal = equal & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return reused.join(s, key, "left").select(key, F.when(F.col("__s").isNull(), "no_source").when(~equal, "altered").alias("fault")).where("fault is not null")


def sequence_faults(candidate: DataFrame, base: DataFrame, delta: DataFrame, ordinal: str, value: str) -> DataFrame:
    """ordinal, fault where candidate isn't base followed by delta (ordinals count from 0): missing, extra or different."""
    n = base.agg(F.count("*")).scalar()
    shifted = delta.select((F.col(ordinal) + n).alias(ordinal), F.col(value).alias("__want"))
    want = base.select(F.col(ordinal).cast("long").alias(ordinal), F.col(value).alias("__want")).union(shifted).withColumn("__w", F.lit(True))
    got = candidate.select(F.col(ordinal).cast("long").alias(ordinal), F.col(value).alias("__got"), F.lit(True).alias("__g"))
    fault = F.when(F.col("__g").isNull(), "missing").when(F.col("__w").isNull(), "extra").when(~F.col("__got").eqNullSafe(F.col("__want")), "different")
    return want.join(got, ordinal, "full").select(ordinal, fault.alias("fault")).where("fault is not null")


def compare_runs(a: DataFrame, b: DataFrame, key: str, passed: str) -> DataFrame:
    """key, change between two runs: fixed, broken, same, only_a, only_b; an unscored pass counts as failed."""
    x = a.select(key, F.coalesce(F.col(passed), F.lit(False)).alias("__a"))
    y = b.select(key, F.coalesce(F.col(passed), F.lit(False)).alias("__b"))
    change = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(F.col("__a") == F.col("__b"), "same").when(F.col("__b"), "fixed").otherwise("broken")
    return x.join(y, key, "full").select(key, change.alias("change"))


def roll_up(findings: list[tuple[str, DataFrame]]) -> DataFrame:
    """kind, n over all tables of findings; a kind without findings has 0."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in findings]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order, from 0, without gathering them in one task."""
    at = rows.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    return rows.sparkSession.createDataFrame(at, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


def ordered_diff(old: DataFrame, new: DataFrame, key: str, ordinal: str, fields: list[str]) -> DataFrame:
    """key, change and moved. change: repeated (in either table), only_old, only_new, changed or same; moved: whether the rows that both have once stand at other places among each other."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias(f"__n{p}"), F.min(ordinal).alias(f"__at{p}"), *(F.min(f).alias(f"__{p}_{f}") for f in fields))

    j = side(old, "o").join(side(new, "n"), key, "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"__o_{f}").eqNullSafe(F.col(f"__n_{f}"))
    change = F.when((F.col("__no") > 1) | (F.col("__nn") > 1), "repeated").when(F.col("__nn").isNull(), "only_old").when(F.col("__no").isNull(), "only_new").when(differs, "changed").otherwise("same")
    j = j.select(key, change.alias("change"), "__ato", "__atn")
    both = j.where(F.col("change").isin("changed", "same"))
    place = [numbered(both.select(key, c), [c, key], f"{c}_place").select(key, f"{c}_place") for c in ("__ato", "__atn")]
    moved = place[0].join(place[1], key).select(key, (F.col("__ato_place") != F.col("__atn_place")).alias("moved"))
    return j.join(moved, key, "left").select(key, "change", F.coalesce("moved", F.lit(False)).alias("moved"))


def unauthorized(changes: DataFrame, allowed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fault where the changed rows (key, changed_fields) aren't the allow-list's: unexpected, not_changed, or forbidden_fields if others than ``fields`` changed."""
    a = allowed.select(key).distinct().withColumn("__a", F.lit(True))
    j = changes.where(F.size("changed_fields") > 0).join(a, key, "full")
    forbidden = F.size(F.array_except("changed_fields", F.array(*map(F.lit, fields)))) > 0
    fault = F.when(F.col("__a").isNull(), "unexpected").when(F.col("changed_fields").isNull(), "not_changed").when(forbidden, "forbidden_fields")
    return j.select(key, fault.alias("fault")).where("fault is not null")


def unmatched_ids(expected: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """key, side of the ids that only one table has: missing from the results, or extra there."""
    a, b = (d.select(key).distinct().withColumn(c, F.lit(True)) for d, c in ((expected, "__e"), (results, "__r")))
    side = F.when(F.col("__r").isNull(), "missing").when(F.col("__e").isNull(), "extra")
    return a.join(b, key, "full").select(key, side.alias("side")).where("side is not null")


def sorted_content(rows: DataFrame, text: str) -> tuple[int, str]:
    """How many rows, and the hash of their texts, sorted and joined by a line feed; one partition at a time comes to the driver."""
    h, n, first = hashlib.sha256(), 0, True
    for r in rows.select(text).orderBy(F.col(text).asc_nulls_first()).toLocalIterator():
        n += 1
        if r[0] is not None:
            h.update(r[0].encode() if first else b"\n" + r[0].encode())
            first = False
    return n, h.hexdigest()


def sorted_contents(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n and content_sha256 of each key: how many rows, and the hash of their texts, sorted and joined by a line feed; null if it has none.

    A hash takes its bytes in order, so a key is hashed by one task, text after text as they come from a sort that spills;
    only the hash's state is kept, and keys of any size fit.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, at, n, h = None, None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(at, kind), pa.array([n], pa.int64()), pa.array([h and h.hexdigest()], pa.string())], names=[key, "n", "content_sha256"])

        for b in batches:
            kind = b.column(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if [k] != at:
                    if at is not None:
                        yield done()
                    at, n, h = [k], 0, None
                n += 1
                if t.is_valid:
                    if h is None:
                        h = hashlib.sha256()
                    else:
                        h.update(b"\n")
                    h.update(t.as_buffer())
        if at is not None:
            yield done()

    in_order = rows.select(key, text).repartition(key).sortWithinPartitions(key, text)
    return in_order.mapInArrow(fold, f"`{key}` {dict(in_order.dtypes)[key]}, n long, content_sha256 string")


def split_conditions(split: str) -> list[tuple[str, Column]]:
    """The ten conditions, in order, for the use of a manifest entry in ``split``; columns w, confirmed, d, a, split and uses."""
    use = lambda name: F.col(f"uses.{name}")
    no = use("training").eqNullSafe(F.lit(False)) & use("publication").eqNullSafe(F.lit(False))
    return [
        ("withdrawal_status", F.col("w") == "active"),
        ("author_confirmed", F.col("confirmed")),
        ("deidentification_status", F.col("d") == "approved"),
        ("annotation_status", F.col("a") == "adjudicated"),
        ("split", F.col("split") == split),
        ("allowed_uses", F.col("uses").isNotNull()),
        ("training_or_publication", no),
        ("private_annotation", use("annotation")),
        ("private_evaluation", use("evaluation")),
        ("holdout_eligible", use("holdout") if split == "real_holdout" else F.lit(True)),
    ]
