"""Candidate responses: JSON of a source text and its proposed output, refused with the first reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Names and limits.
TOP, OUTPUT = ("source_input", "proposed_output"), ("narrative", "bullets", "action_items")
WORDS, SENTENCES, ITEMS = (80, 220), (1, 4), {"bullets": (2, 8), "action_items": (1, 6)}


def _plain(v: Column) -> Column:
    """Whether a variant is a string with more than white space and without control characters."""
    s = F.try_variant_get(v, "$", "string")
    return F.coalesce((F.schema_of_variant(v) == "STRING") & ~s.rlike(r"^[\s\p{Z}]*$") & ~T.has_control(s), F.lit(False))


def _keys(raw: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(names))), F.lit(False))


def _within(n: Column, limits: tuple[int, int]) -> Column:
    return n.between(*limits)


def response_fault(raw: Column) -> Column:
    """The kind of the first fault, null for a good response. Duplicate keys at any depth make JSON invalid."""
    v = F.try_parse_json(raw)
    part = lambda path: F.try_variant_get(v, path, "variant")
    source, narrative = part("$.source_input"), part("$.proposed_output.narrative")
    string = lambda x: F.try_variant_get(x, "$", "string")
    faults = [
        ("response_json_invalid", v.isNull() | raw.startswith("﻿")),
        ("top_level_keys_invalid", ~_keys(raw, TOP)),
        ("source_input_not_plain_string", ~_plain(source)),
        ("source_input_word_count_out_of_range", ~_within(T.word_count(string(source)), WORDS)),
        ("proposed_output_keys_invalid", ~_keys(F.get_json_object(raw, "$.proposed_output"), OUTPUT)),
        ("narrative_not_plain_string", ~_plain(narrative)),
        ("narrative_sentence_count_out_of_range", ~_within(T.sentence_count(string(narrative)), SENTENCES)),
    ]
    out = None
    for kind, bad in faults:
        out = F.when(bad, F.lit(kind)) if out is None else out.when(bad, F.lit(kind))
    for name, limits in ITEMS.items():
        items = F.try_variant_get(v, f"$.proposed_output.{name}", "array<variant>")
        out = out.when(items.isNull(), F.lit("list_not_array")).when(~_within(F.size(items), limits), F.lit("list_item_count_out_of_range")).when(F.exists(items, lambda x: ~_plain(x)), F.lit("list_item_not_plain_string"))
    return F.when(raw.isNull(), F.lit("response_json_invalid")).otherwise(out)
