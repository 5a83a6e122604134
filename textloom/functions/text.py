"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Fixed values that results depend on.
CONTAINMENT_MIN_CHARS = 20
TOKEN_THRESHOLD = 0.15
GRAM_THRESHOLD = 0.10
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can cannot could did do does doing down during each few for from further had has have having he her here hers herself "
    "him himself his how i if in into is it its itself me more most my myself no nor not of off on once only or other ought "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these "
    "they this those through to too under until up very was we were what when where which while who whom why with would you "
    "your yours yourself yourselves"
).split()
CONTENT_STOPWORDS = "a an and are as at be been but by for from had has have i if in is it of on or that the then to was were will with".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
CLAUSE_SPLIT = r"(?:[.!?;\n]+|[\s\p{Z}]+[—–-][\s\p{Z}]+)"
GOOGLE_KEY = r"AIza[0-9A-Za-z_-]{20,}"
BEARER = r"(?i)bearer\s+[A-Za-z0-9._~+\-/]+=*"
SECRET_KEY = r"(?i)(?:api.?key|authorization|credential|secret|token|password|account.?id|billing.?id)"
# < and > stand for the limits of a word
CUES = {
    "question": r"\?|<(?:unclear|unknown|unsure|undecided|can't tell|cannot tell|whether|not sure)>",
    "time_or_condition": r"<(?:before|after|when|while|until|by|tonight|tomorrow|monday|tuesday|wednesday|thursday|friday|saturday|sunday|noon|morning|bed|closes?|opens?|returns?|arrives?)>",
    "destination_or_location": r"<(?:to|into|in|on|at|beside|under|near)[\s\p{Z}]+(?:the|a|an|her|him|them|[a-z])",
    "quantity": r"<(?:one|two|three|four|five|six|seven|eight|\p{Nd}+)>",
    "tentative": r"<(?:maybe|might|may|perhaps|idea|consider|what if|could)>",
}
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TEMPORAL = r"(?i)\b(?:today|tonight|tomorrow|yesterday|morning|afternoon|evening|monday|tuesday|wednesday|thursday|friday|saturday|sunday|week|month|hour|minute|by|before|after)\b"
QUANTITY = r"(?i)\b(?:\d+(?:\.\d+)?|one|two|three|four|five|six|seven|eight|nine|ten)\b"
ENTITY = r"\b[A-Z][a-z]{2,}\b"
ROLE = r"(?i)\b(?:writer|client|vendor|speaker|volunteer|caregiver|recipient|owner)\b"
TENTATIVE = r"(?i)\b(?:maybe|might|may|perhaps|idea|consider|what if|could)\b"


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize(text: Column, nfkc: bool = True) -> Column:
    """Lower case, everything but a-z, 0-9 and space to a space, single spaces. ``nfkc`` first folds compatibility characters in an Arrow UDF."""
    t = F.lower(_nfkc(text) if nfkc else text)
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +", " "))


def tokens(normalized: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def repair_tokens(text: Column) -> Column:
    """The other token set: lower case, all but a-z and space deleted."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z ]", ""), " +"), lambda w: w != ""))


def filtered_tokens(normalized: Column) -> Column:
    return F.array_except(tokens(normalized), F.array(*map(F.lit, STOPWORDS)))


def content_tokens(normalized: Column) -> Column:
    return F.filter(F.array_except(tokens(normalized), F.array(*map(F.lit, CONTENT_STOPWORDS))), lambda w: F.length(w) > 1)


def char_grams(normalized: Column, n: int = 5) -> Column:
    """Distinct n-grams of the text without its spaces; a shorter text is one gram, an empty one has none."""
    s = F.replace(normalized, F.lit(" "), F.lit(""))
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(all_grams(s, n))


def all_grams(s: Column, n: int) -> Column:
    """Distinct n-grams by one scan: substring() would walk a text from its start for each."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))


def filtered_grams(normalized: Column, n: int = 5) -> Column:
    kept = F.filter(F.split(normalized, " "), lambda w: ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), w))
    return char_grams(F.array_join(kept, ""), n)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"['-]*[\p{L}\p{N}_][\p{L}\p{N}_'-]*"))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^.!?]+[.!?](?:\s|$)"))


def segments(text: Column) -> Column:
    """Clauses as they stand: cut at sentence marks, semicolons, line ends and dashes between white space."""
    return F.split(text, CLAUSE_SPLIT)


def clauses(text: Column) -> Column:
    return F.filter(F.transform(segments(text), lambda c: normalize(c, False)), lambda c: c != "")


def entity_terms(text: Column) -> Column:
    """Sorted terms: days in lower case, numbers, and words with a capital that don't begin their sentence (but for I)."""
    words = F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_extract_all(s, F.lit(r"([A-Za-z']+|\p{Nd}+)"), F.lit(1)))

    def term(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(*DAYS), low).when(w.rlike(r"^\p{Nd}") | (w.rlike("^[A-Z]") & (i > 0) & (low != "i")), w)

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(words, lambda ws: F.transform(ws, term))))))


def cue(text: Column, name: str) -> Column:
    """Whether a text has one of the cue phrases, whatever their case, as whole words."""
    return F.coalesce(text.rlike("(?iu)" + CUES[name].replace("<", WORD_START).replace(">", WORD_END)), F.lit(False))


def contains_secret(text: Column) -> Column:
    """An API key, or a bearer token that isn't redacted."""
    return F.coalesce(text.rlike(GOOGLE_KEY) | text.rlike(r"(?i)bearer\s+(?!\[REDACTED\])\S+"), F.lit(False))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BEARER, "Bearer [REDACTED]"), GOOGLE_KEY, "[REDACTED]")


def secret_key(name: Column) -> Column:
    """Whether a key's name says that its value is to be redacted."""
    return name.rlike(SECRET_KEY)


def matches(text: Column, pattern: str, lower: bool = False) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower) if lower else found)


def defang_markers(text: Column) -> Column:
    """A zero-width non-joiner after every second # of runs of three or more."""
    return F.regexp_replace(text, "##(?=#)", "##‌")


def has_control(text: Column) -> Column:
    return text.rlike(r"\p{Cc}")
