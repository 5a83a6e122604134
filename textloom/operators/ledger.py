"""Hash-chained ledgers, integer costs and budget gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import json_object, json_string

MILLION = 1_000_000


def member(df: DataFrame, name: str) -> Column:
    """A column as canonical JSON: strings quoted, numbers and booleans as they are, nulls as null."""
    c = F.col(name)
    return json_string(c) if dict(df.dtypes)[name] == "string" else F.coalesce(c.cast("string"), F.lit("null"))


def row_json(df: DataFrame, payload: list[str], prior: Column, sequence: Column) -> Column:
    """Canonical JSON of a ledger row of any fields: keys sorted, no spaces, a newline at the end."""
    members = {**{p: member(df, p) for p in payload}, "prior_row_hash": prior, "sequence": sequence.cast("string")}
    return F.concat(json_object(members), F.lit("\n"))


def build_chain(rows: DataFrame, run: str, order: str, payload: str | list[str]) -> DataFrame:
    """run, sequence (1..), the payload's fields, prior_row_hash, row_hash.

    A row needs the hash of the one before, so a run is hashed by one task, row after row as they come in order; only the
    last hash is kept, and runs of any length fit.
    """
    fields = [payload] if isinstance(payload, str) else payload
    numbered = rows.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(order)))
    mark = "\x00"
    texts = numbered.select(run, "sequence", *fields, row_json(numbered, fields, F.lit(mark), F.col("sequence")).alias("row"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in texts.dtypes if c != "row")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prior = None, None
        for b in batches:
            priors, hashes = [], []
            for key, text in zip(b.column(run).to_pylist(), b.column("row").to_pylist(), strict=True):
                if (key,) != at:
                    at, prior = (key,), None
                priors.append(prior)
                prior = hashlib.sha256(text.replace(mark, "null" if prior is None else f'"{prior}"', 1).encode()).hexdigest()
                hashes.append(prior)
            kept = [c for c in b.schema.names if c != "row"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(priors, pa.string()), pa.array(hashes, pa.string())], names=[*kept, "prior_row_hash", "row_hash"])

    in_order = texts.repartition(run).sortWithinPartitions(run, "sequence")
    return in_order.mapInArrow(fold, f"{kinds}, prior_row_hash string, row_hash string")


def verify_chain(chain: DataFrame, run: str, payload: list[str] | None = None) -> DataFrame:
    """run, n and the first broken sequence (null if whole): order, prior hash and own hash are tested row by row."""
    fields = payload or ["payload"]
    w = Window.partitionBy(run).orderBy("sequence")
    tested = chain.withColumns({"__i": F.row_number().over(w), "__p": F.lag("row_hash").over(w)})
    own = F.sha2(row_json(chain, fields, json_string(F.col("prior_row_hash")), F.col("sequence")), 256)
    good = (F.col("sequence") == F.col("__i")) & F.col("prior_row_hash").eqNullSafe(F.col("__p")) & F.col("row_hash").eqNullSafe(own)
    return tested.groupBy(run).agg(F.count("*").alias("n"), F.min(F.when(~good, F.col("sequence"))).alias("first_broken"))


def ceiling_cost(units: Column, rate: Column | int) -> Column:
    """Millionths for units at a rate per million, rounded up, in whole numbers."""
    up = units * rate + (MILLION - 1)
    return ((up - up % MILLION) / MILLION).cast("long")


def budget_gate(costs: DataFrame, run: str, order: str, cost: str, reserve: int, stop: int, spent: int = 0) -> DataFrame:
    """Each row with what was spent before it and whether its reservation fits below the stop."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(cost).over(w), F.lit(0)).cast("long")
    return costs.withColumn("spent_before", before + spent).withColumn("fits", F.col("spent_before") + reserve <= stop)
