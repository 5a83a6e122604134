"""Benchmark reports: binding to frozen probes, pass predicates, unscored results and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unknown_dimensions(required: Column, known: list[str]) -> Column:
    return F.array_except(required, F.array(*map(F.lit, known)))


def checked_dimensions(required: Column, known: list[str]) -> Column:
    """``required``; raises, when run, if it names a dimension that isn't known."""
    unknown = unknown_dimensions(required, known)
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("required dimensions not recognized: "), F.array_join(unknown, ",")))).otherwise(required)


def binding_fault(same: list[tuple[str, Column, Column]], stored_checks: Column, expected_checks: Column) -> Column:
    """The first field in which a result differs from its frozen probe, null-safe, then the set of check names; null if bound."""
    faults = [F.when(~stored.eqNullSafe(frozen), F.lit(name)) for name, stored, frozen in same]
    keys = F.when(F.array_sort(F.array_distinct(stored_checks)) != F.array_sort(F.array_distinct(expected_checks)), F.lit("capability_checks"))
    return F.coalesce(*faults, keys)


def has_unscored(scores: Column, checks: Column) -> Column:
    return F.exists(F.map_values(scores), lambda v: v.isNull()) | F.exists(F.map_values(checks), lambda v: v.isNull())


def all_unscored(scores: Column, checks: Column) -> Column:
    return F.forall(F.map_values(scores), lambda v: v.isNull()) & F.forall(F.map_values(checks), lambda v: v.isNull())


def strict_pass(format_valid: Column, scores: Column, dimensions: list[str], checks: Column) -> Column:
    """Null if any score or check is null, else whether the format is valid and all are true.

    Raises, when run, if format_valid is null or a dimension is missing.
    """
    missing = F.array_except(F.array(*map(F.lit, dimensions)), F.map_keys(scores))
    values = F.concat(F.transform(F.array(*map(F.lit, dimensions)), lambda d: scores[d]), F.map_values(checks))
    result = F.when(F.exists(values, lambda v: v.isNull()), F.lit(None).cast("boolean")).otherwise(format_valid & F.forall(values, lambda v: v))
    refused = F.when(format_valid.isNull(), "format_valid must be a boolean").when(F.size(missing) > 0, F.concat(F.lit("missing dimensions: "), F.array_join(missing, ",")))
    return F.when(refused.isNotNull(), F.raise_error(refused).cast("boolean")).otherwise(result)


def structured_pass(integrity_fault: Column, passes: Column, rules: list[Column]) -> Column:
    """Raises, when run, on a record that contradicts itself; then the pass predicate and every count rule (null: no rule)."""
    met = passes
    for r in rules:
        met = met & F.coalesce(r, F.lit(True))
    return F.when(integrity_fault.isNotNull(), F.raise_error(F.concat(F.lit("inconsistent record: "), integrity_fault)).cast("boolean")).otherwise(met)
