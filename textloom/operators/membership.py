"""Membership, classification and sequence checks between splits, and the choice of one supplement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of safe identifiers.
IDENTIFIER = "^[A-Za-z0-9_-]+$"


def safe_identifier(c: Column) -> Column:
    """Whether an identifier can't leave its folder; null isn't safe."""
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def membership_faults(wanted: DataFrame, train: DataFrame, absent: dict[str, DataFrame], key: str) -> DataFrame:
    """key, fault of wanted keys that train doesn't hold exactly once, or that a table of ``absent`` holds (its name is the fault)."""
    n = train.groupBy(key).agg(F.count("*").alias("__n"))
    keys = wanted.select(key).distinct()
    out = keys.join(n, key, "left").select(key, F.when(F.col("__n").isNull(), "not_in_train").when(F.col("__n") > 1, "repeated").alias("fault")).where("fault is not null")
    for name, df in absent.items():
        out = out.union(keys.join(df.select(key), key, "left_semi").select(key, F.lit(name).alias("fault")))
    return out


def classification_faults(items: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key, fault of items that no rule row or more than one classifies: unclassified or double_classified."""
    n = rules.groupBy(key).agg(F.count("*").alias("__n"))
    fault = F.when(F.col("__n").isNull(), "unclassified").when(F.col("__n") > 1, "double_classified")
    return items.select(key).distinct().join(n, key, "left").select(key, fault.alias("fault")).where("fault is not null")


def split_comparison(a: DataFrame, b: DataFrame, split: str, ordinal: str, value: str) -> DataFrame:
    """split, n_a, n_b, equal: rows of each split in both corpora, and whether the values in order are the same."""
    x = a.select(split, ordinal, F.col(value).alias("__a"), F.lit(1).alias("__x"))
    y = b.select(split, ordinal, F.col(value).alias("__b"), F.lit(1).alias("__y"))
    same = F.col("__x").isNotNull() & F.col("__y").isNotNull() & F.col("__a").eqNullSafe(F.col("__b"))
    return x.join(y, [split, ordinal], "full").groupBy(split).agg(F.count("__x").alias("n_a"), F.count("__y").alias("n_b"), F.bool_and(same).alias("equal"))


def best_each(rows: DataFrame, group: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group by ``order`` (ascending keys; negate a number to descend), as an aggregate: no group is sorted."""
    return rows.groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__best")).select(group, "__best.*")
