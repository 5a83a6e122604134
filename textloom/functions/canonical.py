"""Canonical JSON as column expressions: sorted keys, no spaces, characters beyond ASCII as they are; and fingerprints over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(text: Column) -> Column:
    """A JSON string; a null is null. Control characters without a short form become \\u00xx in lower-case hexadecimal."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, short in SHORT.items():
        out = F.replace(out, F.lit(c), F.lit(short))
    rare = out
    for code in range(32):
        if chr(code) not in SHORT:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    quoted = F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def json_object(members: dict[str, Column]) -> Column:
    """An object of members that are JSON already, in the order of their names."""
    parts: list[Column] = [F.lit("{")]
    for i, (k, v) in enumerate(sorted(members.items())):
        parts += [F.lit(("," if i else "") + f'"{k}":'), v]
    return F.concat(*parts, F.lit("}"))


def json_array(items: Column) -> Column:
    """An array of items that are JSON already."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def fingerprint(members: dict[str, Column], omit: str | None = None) -> Column:
    """SHA-256 of the canonical object, without the member that holds the fingerprint itself."""
    return F.sha2(json_object({k: v for k, v in members.items() if k != omit}), 256)


def prefixed(fingerprint: Column) -> Column:
    return F.when(fingerprint.startswith("sha256:"), fingerprint).otherwise(F.concat(F.lit("sha256:"), fingerprint))
