"""Report predicates, canonical JSON and text cues against plain Python."""

import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import canonical as J
from textloom.functions import text as T
from textloom.functions.responses import response_fault
from textloom.operators import curation as K
from textloom.operators import reports as R

TEXTS = ["", "plain", 'q"uo\\te', "a\nb\tc\r\x0c\x08", "\x00\x0b\x1f\x1a \\u000B", "Ünï — 日本 🙂", "/slash\x7f", None, "Ask Bob. I met Ann on Friday, 12 of them! he's O'Neil"]


def test_canonical_json_is_that_of_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in rows.select("t", J.json_string(F.col("t")).alias("j"), J.fingerprint({"b": J.json_string(F.col("t")), "a": F.lit("1"), "own": F.lit("2")}, "own").alias("f")).collect():
        assert r.j == json.dumps(r.t, ensure_ascii=False)
        assert r.f == hashlib.sha256(json.dumps({"a": 1, "b": r.t}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def plain_terms(text):
    out = set()
    for s in re.split(r"[.!?]+", text):
        for n, w in enumerate(re.findall(r"[A-Za-z']+|\d+", s)):
            if w.lower() in T.DAYS:
                out.add(w.lower())
            elif w.isdigit() or (w[:1].isupper() and n and w.lower() != "i"):
                out.add(w)
    return sorted(out)


def test_text_cues(spark):
    texts = [t for t in TEXTS if t is not None] + ["Wait – what; no-go - yes", "could it be? maybe", "xcould ycan't tell", "écould", "AIza" + "k" * 20, "bearer [REDACTED]", "Bearer a.b=="]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [T.entity_terms(F.col("t")).alias("e"), T.segments(F.col("t")).alias("s"), T.contains_secret(F.col("t")).alias("k"), T.redact_secrets(F.col("t")).alias("r"), T.cue(F.col("t"), "tentative").alias("c")]
    for r in rows.select("t", *cols).collect():
        assert r.e == plain_terms(r.t)
        assert r.s == re.split(r"(?:[.!?;\n]+|\s+[—–-]\s+)", r.t)
        assert r.k == bool(re.search(r"AIza[0-9A-Za-z_-]{20,}", r.t) or re.search(r"(?i)bearer\s+(?!\[REDACTED\])\S+", r.t))
        assert r.c == bool(re.search(r"(?i)\b(?:maybe|might|may|perhaps|idea|consider|what if|could)\b", r.t))
        assert "AIza" not in r.r and "a.b" not in r.r
    assert T.entity_terms(F.lit(None).cast("string")) is not None and spark.range(1).select(T.cue(F.lit(None).cast("string"), "quantity")).first()[0] is False


def test_reports_refuse_what_they_do_not_know(spark):
    one = spark.range(1)
    scores = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(None).cast("int"))
    checks = F.create_map(F.lit("c"), F.lit(True))
    passes = lambda required: one.select(K.probe_passes(F.lit(True), scores, R.checked_dimensions(F.array(*map(F.lit, required)), ["a", "b"]), checks)).first()[0]
    assert passes(["a"]) is True and passes(["b"]) is False
    with pytest.raises(Exception, match="not recognized: z"):
        passes(["a", "z"])
    true = F.create_map(F.lit("a"), F.lit(True))
    strict = lambda valid, dims, c=checks: one.select(R.strict_pass(valid, true, dims, c)).first()[0]
    assert strict(F.lit(True), ["a"]) is True and strict(F.lit(False), ["a"]) is False
    assert strict(F.lit(True), ["a"], F.create_map(F.lit("c"), F.lit(None).cast("boolean"))) is None
    with pytest.raises(Exception, match="missing dimensions: d"):
        strict(F.lit(True), ["a", "d"])
    with pytest.raises(Exception, match="must be a boolean"):
        strict(F.lit(None).cast("boolean"), ["a"])
    with pytest.raises(Exception, match="inconsistent record: x"):
        one.select(R.structured_pass(F.lit("x"), F.lit(True), [])).first()
    assert one.select(R.structured_pass(F.lit(None).cast("string"), F.lit(True), [F.lit(None).cast("boolean"), F.lit(False)])).first()[0] is False


def plain_fault(raw):
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    plain = lambda x: isinstance(x, str) and bool(x.strip()) and not any(unicodedata.category(c) == "Cc" for c in x)
    try:
        v = json.loads(raw, object_pairs_hook=once)
    except ValueError:
        return "response_json_invalid"
    if not isinstance(v, dict) or set(v) != {"source_input", "proposed_output"}:
        return "top_level_keys_invalid"
    if not plain(v["source_input"]):
        return "source_input_not_plain_string"
    if not 80 <= len(re.findall(r"\b[\w'-]+\b", v["source_input"])) <= 220:
        return "source_input_word_count_out_of_range"
    o = v["proposed_output"]
    if not isinstance(o, dict) or set(o) != {"narrative", "bullets", "action_items"}:
        return "proposed_output_keys_invalid"
    if not plain(o["narrative"]):
        return "narrative_not_plain_string"
    if not 1 <= len(re.findall(r"[^.!?]+[.!?](?:\s|$)", o["narrative"])) <= 4:
        return "narrative_sentence_count_out_of_range"
    for name, least, most in (("bullets", 2, 8), ("action_items", 1, 6)):
        if not isinstance(o[name], list):
            return "list_not_array"
        if not least <= len(o[name]) <= most:
            return "list_item_count_out_of_range"
        if not all(map(plain, o[name])):
            return "list_item_not_plain_string"
    return None


def test_responses_are_refused_for_the_first_reason(spark):
    good = {"source_input": "word " * 100, "proposed_output": {"narrative": "One. Two.", "bullets": ["a", "b"], "action_items": ["c"]}}
    swap = lambda **o: {**good, "proposed_output": {**good["proposed_output"], **o}}
    values = [good, {**good, "x": 1}, {"source_input": "a"}, [good], 5, "s", {**good, "source_input": 5}, {**good, "source_input": " 　"}, {**good, "source_input": "a\u0001" * 90}, {**good, "source_input": "few words"}, {**good, "source_input": "w " * 221}]
    values += [{**good, "proposed_output": None}, {**good, "proposed_output": []}, {**good, "proposed_output": {}}, swap(y=1), swap(narrative=None), swap(narrative="\t"), swap(narrative="no end"), swap(narrative="A. " * 5), swap(bullets="x"), swap(bullets=None), swap(bullets=["a"])]
    values += [swap(bullets=["a"] * 9), swap(bullets=["a", 1]), swap(bullets=["a", " "]), swap(action_items=[]), swap(action_items=["a"] * 7), swap(action_items=["x\n"]), swap(action_items={"a": "b"})]
    raws = [json.dumps(v) for v in values] + ["", "{", '{"source_input": "a", "source_input": "b", "proposed_output": 1}', json.dumps(good).replace('"narrative"', '"narrative": "z", "narrative"')]
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", response_fault(F.col("raw")).alias("fault")).collect()
    assert [(r.raw[:80], r.fault) for r in rows] == [(r[:80], plain_fault(r)) for r in raws]
    assert len({r.fault for r in rows}) == 11 and spark.createDataFrame([(None,)], "raw string").select(response_fault(F.col("raw"))).first()[0] == "response_json_invalid"


def test_pairs_that_share_terms(spark):
    from textloom.operators import collision as C

    texts = ["We met Ann and Bob on Friday.", "Then Bob saw Ann.", "Then Ann left.", "On 12 May, friday.", "No names."]
    side = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.entity_terms(F.col("t")).alias("elements"))
    terms = [set(plain_terms(t)) for t in texts]
    want = {(i, j, len(a & b)) for i, a in enumerate(terms) for j, b in enumerate(terms) if len(a & b) >= 2}
    assert {tuple(r) for r in C.shared_terms(side, side).collect()} == want and (0, 1, 2) in want
