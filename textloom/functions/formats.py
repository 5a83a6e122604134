"""Marker formats: build, check and parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
NARRATIVE, BULLETS, ACTIONS = "###NARRATIVE###", "###BULLETS###", "###ACTIONS###"
BULLET_ITEM, ACTION_ITEM = "###BULLET###", "###ACTION###"
BLANK = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def build_v1(narrative: Column, bullets: Column, actions: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit(NARRATIVE), strip(narrative), F.lit(BULLETS)), bullets, F.array(F.lit(ACTIONS)), actions), "\n")


def build_v2(narrative: Column, bullets: Column, actions: Column) -> Column:
    def marked(items: Column, marker: str) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit(f"{marker} "), x))

    head = F.array(F.lit(NARRATIVE), strip(narrative), F.lit(BULLETS))
    return F.array_join(F.concat(head, marked(bullets, BULLET_ITEM), F.array(F.lit(ACTIONS)), marked(actions, ACTION_ITEM)), "\n")


def valid_v1(text: Column) -> Column:
    n, b, a = (F.instr(text, m) for m in (NARRATIVE, BULLETS, ACTIONS))
    body = F.substring(text, n + len(NARRATIVE), b - n - len(NARRATIVE))
    return (n > 0) & (b > n) & (a > b) & (strip(body) != "")


def _times(text: Column, marker: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def parse_v2(text: Column) -> Column:
    """Struct of error (null if the text parses), narrative, bullets, actions. The first broken rule gives the error."""
    n, b, a = (F.instr(text, m) for m in (NARRATIVE, BULLETS, ACTIONS))
    narrative = strip(F.substring(text, n + len(NARRATIVE), b - n - len(NARRATIVE)))
    sections = F.substring(text, b + len(BULLETS), a - b - len(BULLETS)), F.substring(text, a + len(ACTIONS), F.length(text))
    error = F.lit(None).cast("string")
    parts, rules = [], []
    for section, mine, other, name in ((sections[0], BULLET_ITEM, ACTION_ITEM, "bullets"), (sections[1], ACTION_ITEM, BULLET_ITEM, "actions")):
        split = F.transform(F.split(section, mine), strip)
        items = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))
        rules += [(_times(section, other) > 0, f"{name}_leakage"), ((F.size(split) == 1) & (split[0] != ""), f"{name}_bare"), (split[0] != "", f"{name}_preamble"), (F.exists(items, lambda x: x == ""), f"{name}_empty_item")]
        parts.append(items)
    rules = [
        *((_times(text, m) == 0, f"missing_{k}") if missing else (_times(text, m) > 1, f"duplicated_{k}") for m, k in ((NARRATIVE, "narrative"), (BULLETS, "bullets"), (ACTIONS, "actions")) for missing in (True, False)),
        (~((n < b) & (b < a)), "out_of_order"),
        (strip(F.substring(text, F.lit(1), n - 1)) != "", "preamble"),
        (narrative == "", "narrative_empty"),
        *rules,
    ]
    for test, code in reversed(rules):
        error = F.when(test, code).otherwise(error)
    return F.struct(error.alias("error"), *(F.when(error.isNull(), c).alias(k) for k, c in (("narrative", narrative), ("bullets", parts[0]), ("actions", parts[1]))))


def percent(passed: Column, total: Column) -> Column:
    """k/n (p%), rounded half to even."""
    rate = F.bround(100 * passed / total, 0).cast("int")
    return F.when(total == 0, "n/a (0 probes)").otherwise(F.concat(passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), rate.cast("string"), F.lit("%)")))
