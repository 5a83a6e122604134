"""Splits, diffs, corrections, reviews, quotas, status and closure over governed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_by_manifest(rows: DataFrame, pinned: DataFrame, text: str) -> DataFrame:
    """rows with input_sha256 and split: val if the hash is pinned, else train."""
    hashed = rows.withColumn("input_sha256", F.sha2(text, 256))
    val = pinned.select("input_sha256").distinct().withColumn("__val", F.lit(True))
    return hashed.join(val, "input_sha256", "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")


def missing_pins(rows: DataFrame, pinned: DataFrame, text: str) -> DataFrame:
    return pinned.join(rows.select(F.sha2(text, 256).alias("input_sha256")), "input_sha256", "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change (added, removed, changed, same) and changed_fields."""
    a = old.select(key, *(F.col(f).alias(f"__o_{f}") for f in fields), F.lit(True).alias("__old"))
    b = new.select(key, *(F.col(f).alias(f"__n_{f}") for f in fields), F.lit(True).alias("__new"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"__o_{f}").eqNullSafe(F.col(f"__n_{f}")), F.lit(f)) for f in fields)))
    both = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return a.join(b, key, "full").select(key, kind.alias("change"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"))


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: str, field: str) -> DataFrame:
    """rows with field replaced where a correction (key, current, corrected) names its present value; drift marks a correction that doesn't."""
    j = rows.join(corrections.select(key, F.col("current").alias("__c"), F.col("corrected").alias("__n"), F.lit(True).alias("__hit")), key, "left")
    fits = F.col("__hit").isNotNull() & F.col(field).eqNullSafe(F.col("__c"))
    return j.withColumn("drift", F.col("__hit").isNotNull() & ~fits).withColumn(field, F.when(fits, F.col("__n")).otherwise(F.col(field))).drop("__c", "__n", "__hit")


def probe_passes(format_valid: Column, scores: Column, required: Column, checks: Column) -> Column:
    bad = F.exists(F.map_values(scores), lambda v: v.isNotNull() & (v != 2))
    unmet = F.exists(required, lambda d: F.coalesce(scores[d] != 2, F.lit(True)))
    failed = F.exists(F.map_values(checks), lambda v: ~F.coalesce(v, F.lit(False)))
    return F.coalesce(format_valid, F.lit(False)) & ~bad & ~unmet & ~failed


def count_rule(op: Column, value: Column, n: Column) -> Column:
    """No rule holds always; a rule on what can't be counted fails."""
    return F.when(op.isNull(), True).when(n.isNull(), False).when(op == "exact", n == value).when(op == "max", n <= value).otherwise(False)


def largest_remainder(strata: DataFrame, weight: str, key: str, total: int, seed: str) -> DataFrame:
    """Quotas that sum to total; ties of the remainder go by a seeded hash of the key. The strata are a small table."""
    all_ = Window.partitionBy()
    raw = F.lit(total) * F.col(weight) / F.sum(weight).over(all_)
    d = strata.withColumn("__raw", raw).withColumn("__low", F.floor("__raw").cast("long"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round(F.col("__raw") - F.col("__low"), 9).desc(), F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)))
    return d.withColumn("__rank", rank).withColumn("quota", F.col("__low") + (F.col("__rank") <= total - F.sum("__low").over(all_)).cast("long")).drop("__raw", "__low", "__rank")


def active_status(artifacts: DataFrame, events: DataFrame, ref: list[str]) -> DataFrame:
    """status of each artifact: invalidated over superseded over active, whatever the order of events."""
    rank = F.when(F.col("status") == "invalidated", 2).when(F.col("status") == "superseded", 1).otherwise(0)
    worst = events.select(*ref, rank.alias("__r")).groupBy(*ref).agg(F.max("__r").alias("__r"))
    label = F.when(F.col("__r") == 2, "invalidated").when(F.col("__r") == 1, "superseded").otherwise("active")
    return artifacts.join(worst, ref, "left").withColumn("status", label).drop("__r")


def closure(roots: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """id, depth of all that hang on the roots, level by level; edges[i] has parent and child."""
    level = roots.select(F.col("id"), F.lit(0).alias("depth")).distinct()
    out = level
    for i, e in enumerate(edges, 1):
        level = e.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id"), F.lit(i).alias("depth")).distinct()
        out = out.union(level)
    return out


def transitions(rows: DataFrame, key: str, order: str, state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """key and its number of transitions that aren't allowed."""
    w = Window.partitionBy(key).orderBy(order)
    pair = F.concat_ws(">", F.lag(state).over(w), F.col(state))
    d = rows.select(key, pair.alias("p"), F.lag(state).over(w).alias("l"))
    return d.where("l is not null").groupBy(key).agg(F.count("*").alias("n_transitions"), F.sum((~F.col("p").isin([f"{a}>{b}" for a, b in allowed])).cast("long")).alias("n_bad"))


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the broken rules, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))


def fail_closed(df: DataFrame, column: str = "violations") -> DataFrame:
    """Raises, when run, at the first row with a violation."""
    return df.where(F.when(F.size(column) > 0, F.raise_error(F.concat(F.lit("violations: "), F.array_join(column, ",")))).otherwise(F.lit(True)).cast("boolean"))
