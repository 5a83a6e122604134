"""Sources and sinks over small files with each fault."""

import hashlib
import json

import pytest

from textloom.sources import jsonl as S


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_lines_have_numbers_and_errors(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"a": 1}\n\n  \n{"a": 2, "a": 3}\nnot json\n[1]\n{"a": {"b": 1, "b": 2}}\n')
    loose = {(r.line, r.error) for r in S.read_jsonl(spark, path, "a int").collect()}
    assert loose == {(1, None), (4, None), (5, "invalid JSON"), (6, "not an object"), (7, None)}
    strict = {(r.line, r.error) for r in S.read_jsonl(spark, path, "a int", strict=True).collect()}
    assert strict == {(1, None), (4, "duplicate key"), (5, "invalid JSON"), (6, "not an object"), (7, "duplicate key")}
    with pytest.raises(Exception, match="a.jsonl:"):
        S.refuse(S.read_jsonl(spark, path, "a int")).collect()
    assert S.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_manifest_refuses_blank_lines_and_repeated_keys(spark, tmp_path):
    path = put(tmp_path, "m.jsonl", '{"record_id": "a"}\n\n{"record_id": "b"}\n{"record_id": "a"}\n{"x": 1}\n')
    got = {(r.line, r.error) for r in S.read_manifest(spark, path, "record_id string").collect()}
    assert got == {(1, None), (2, "blank line"), (3, None), (4, "duplicate record_id"), (5, "missing record_id")}


def test_pinned_files(spark, tmp_path):
    good = b"a\nb\n"
    digest = hashlib.sha256(good).hexdigest()
    cases = {"lf": (good, None), "crlf": (b"a\r\nb\r\n", None), "bom": (b"\xef\xbb\xbfa\nb\n", "bom"), "end": (b"a\nb", "no_final_newline"), "cr": (b"a\rb\n", "bare_cr"), "mixed": (b"a\r\nb\n", "mixed_endings"), "utf8": (b"\xff\nb\n", "not_utf8"), "other": (b"a\nc\n", "hash_mismatch")}
    for name, (data, error) in cases.items():
        r = S.read_pinned(spark, put(tmp_path, name, data), digest, 2).first()
        assert r.error == error, name
        assert r.byte_sha256 == hashlib.sha256(data).hexdigest()
    assert S.read_pinned(spark, str(tmp_path / "lf"), None, 3).first().error == "row_count"
    assert [(r.label, r.line, r.raw) for r in S.label_lines(spark, {"x": (str(tmp_path / "lf"), digest, 2)}).collect()] == [("x", 1, "a"), ("x", 2, "b")]
    with pytest.raises(ValueError, match="y: hash_mismatch"):
        S.label_lines(spark, {"y": (str(tmp_path / "other"), digest, 2)})
    with pytest.raises(ValueError, match="z: empty"):
        S.label_lines(spark, {"z": (put(tmp_path, "empty", b""), digest, 2)})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "x")], "id int, t string")
    at = str(tmp_path / "out")
    for _ in range(2):
        S.write_sorted(rows, "id", at)
        assert [json.loads(r.value) for r in spark.read.text(at).collect()] == [{"id": 1, "t": "x"}, {"id": 2, "t": None}]
    with pytest.raises(Exception, match="(?i)exist"):
        S.write_exclusive(rows, at)
    with pytest.raises(FileExistsError):
        S.refuse_existing(spark, [str(tmp_path / "free"), at])
    path = put(tmp_path, "array.json", '[{"id": 1}, {"id": 2}]')
    assert sorted(r.id for r in S.read_array(spark, path, "id int").collect()) == [1, 2]
