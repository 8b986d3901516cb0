"""Readers and writers: what is refused, and that two writes give the same bytes."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradewell.functions.canonical import case_digest, case_json, dataset_digest
from gradewell.operators.journal import digest_faults
from gradewell.sources import readers, sinks


def case(case_id, **more):
    tools = ["get_record"]
    return {
        "input": {"case_id": case_id, "family_id": "f", "languages": ["en"], "messages": [{"role": "user", "content": "hi"}], "evidence": [], "available_tools": tools, "permitted_tools": tools, "evaluation_time_utc": "2026-01-15T12:00:00Z"} | more,
        "gold": {"case_id": case_id, "expected_decision": "CALL_TOOL", "expected_answerability": "NOT_APPLICABLE", "permitted_tools": tools, "expected_tool_call": {"tool": "get_record", "arguments": {"record_id": "r"}}, "expected_claims": [], "rubric": "x"},
        "split": "development_pilot", "source": "s", "provenance": "p", "license": "l", "review_status": "harness_only",
    }


def write(path: Path, value) -> str:
    path.write_text("﻿" + json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_cases(spark, tmp_path):
    cases = [case("b"), case("a", messages=[{"role": "user", "content": "größe"}])]
    read = readers.read_cases(spark, write(tmp_path / "cases.json", cases))
    assert [r["case_id"] for r in read.orderBy("pos").collect()] == ["b", "a"]
    for c in cases:  # the digest is that of sorted, compact JSON with defaults filled in
        for part in (c, c["input"], c["gold"]):
            part["schema_version"] = "1.0"
    compact = [json.dumps(c, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for c in cases]
    rows = read.withColumn("json", case_json(F.struct("gold", "input", "license", "provenance", "review_status", "schema_version", "source", "split")))
    assert {r[0]: r[1] for r in rows.select("case_id", case_digest(F.col("json"))).collect()} == {c["input"]["case_id"]: hashlib.sha256((t + "\n").encode()).hexdigest() for c, t in zip(cases, compact, strict=True)}
    assert dataset_digest(rows, "pos", "json").first()[0] == hashlib.sha256(("[" + ",".join(compact) + "]\n").encode()).hexdigest()


@pytest.mark.parametrize(("more", "rule"), [({"languages": []}, "V02"), ({"messages": []}, "V03"), ({"evaluation_time_utc": "2026-01-15T12:00:00"}, "V01"), ({"permitted_tools": ["calculate"]}, "V05"), ({"available_tools": ["get_record", "get_record"]}, "V04")])
def test_bad_cases_refuse_the_file(spark, tmp_path, more, rule):
    with pytest.raises(ValueError, match=rule):
        readers.read_cases(spark, write(tmp_path / "cases.json", [case("a", **more)]))


def test_repeated_cases_refuse_the_file(spark, tmp_path):
    with pytest.raises(ValueError, match="V20: a"):
        readers.read_cases(spark, write(tmp_path / "cases.json", [case("a"), case("a")]))


def bundle(spark, target):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    sinks.write_run_bundle(
        spark, target, config=t([(1,)], "a int"), environment=t([("x",)], "e string"), manifest=t([("m", None)], "m string, n string"), inputs=t([("b", "1"), ("a", "2")], "case_id string, sha string"), outputs=t([(1, "b", None), (0, "a", "t")], "pos int, case_id string, raw string"),
        scores=t([("b", "m", 1.0), ("a", "m", None)], "case_id string, metric_id string, value double"), metrics=t([("m", None)], "metric_id string, estimate double"), events=t([(2, "b"), (1, "a")], "sequence int, case_id string"), failures=t([("a", None)], "case_id string, error string"),
        timing=sinks.timing_reference(t([("a", "completed"), ("b,c", "timeout")], "case_id string, status string")),
    )


def test_bundle(spark, tmp_path):
    for name in ("one", "two"):
        bundle(spark, str(tmp_path / name))
    files = {p.name: p.read_bytes() for p in (tmp_path / "one").iterdir() if not p.name.startswith(".")}
    assert len(files) == 11 and files == {p.name: p.read_bytes() for p in (tmp_path / "two").iterdir() if not p.name.startswith(".")}
    assert files["outputs.jsonl"] == b'{"case_id":"a","raw":"t"}\n{"case_id":"b"}\n' and files["metrics.json"] == b'[{"estimate":null,"metric_id":"m"}]\n'
    assert files["timing.csv"] == b'case_id,attempt_status,elapsed_seconds,timing_mode\na,completed,0.000000,synthetic_reference_zero\n"b,c",timeout,0.000000,synthetic_reference_zero\n'
    listed = dict(line.split("  ")[::-1] for line in files["checksums.sha256"].decode().splitlines())
    assert listed == {n: hashlib.sha256(b).hexdigest() for n, b in files.items() if n != "checksums.sha256"} and list(listed) == sorted(listed)
    expected = readers.read_checksums(spark, str(tmp_path / "one/checksums.sha256"))
    assert digest_faults(expected, readers.file_digests(spark, str(tmp_path / "one")).where("path <> 'checksums.sha256'")).isEmpty()
    assert readers.one_checksum(expected, "timing.csv").first()["sha256"] == listed["timing.csv"]
    (tmp_path / "one/.timing.csv.crc").unlink(missing_ok=True)  # Spark has its own checksums on local disks
    (tmp_path / "one/timing.csv").write_text("changed")
    assert {tuple(r) for r in digest_faults(expected, readers.file_digests(spark, str(tmp_path / "one")).where("path <> 'checksums.sha256'")).collect()} == {("timing.csv", "mismatch")}
    with pytest.raises(FileExistsError):
        bundle(spark, str(tmp_path / "one"))


def test_objects_and_schemas(spark, tmp_path):
    assert readers.read_object(spark, write(tmp_path / "o.json", {"a": 1})).first()["a"] == 1
    with pytest.raises(Exception, match="not exactly one"):
        readers.read_object(spark, write(tmp_path / "l.json", [{"a": 1}, {"a": 2}])).collect()
    sinks.export_schemas(spark, str(tmp_path / "schemas"))
    assert json.loads((tmp_path / "schemas/case.schema.json").read_text())["type"] == "struct"
    with pytest.raises(FileExistsError):
        sinks.export_schemas(spark, str(tmp_path / "schemas"))


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        (lambda c: c.update(more=1), "unknown more"), (lambda c: c["input"].update(more=1), "unknown input.more"), (lambda c: c["gold"]["expected_tool_call"].update(more=1), "unknown gold.expected_tool_call.more"), (lambda c: c.pop("license"), "missing license"),
        (lambda c: c.update(source=""), "invalid source"), (lambda c: c["gold"].update(expected_decision="FLY"), "invalid gold.expected_decision"), (lambda c: c["gold"].update(expected_answerability="MAYBE"), "invalid gold.expected_answerability"),
        (lambda c: c["gold"]["expected_tool_call"].update(tool="nope"), "invalid gold.expected_tool_call.tool"), (lambda c: c["input"]["messages"][0].update(role="robot"), "invalid input.messages"), (lambda c: c["input"].update(evaluation_time_utc="soon"), "invalid input.evaluation_time_utc"),
        (lambda c: c["input"].update(family_id=5), "invalid input.family_id"), (lambda c: c.update(split="test"), "invalid split"), (lambda c: c["input"]["messages"][0].update(content="x" * 20001), "invalid input.messages"),
    ],
)
def test_contract_of_cases(change, fault):
    import copy

    from gradewell.contracts import faults_of

    c = copy.deepcopy(case("a"))
    assert faults_of(json.dumps(c), "eval_case") == []
    change(c)
    assert any(f"{f} {p}".startswith(fault) for p, f in faults_of(json.dumps(c), "eval_case"))


def test_left_out_lists_are_empty(spark, tmp_path):
    c = case("a")
    for name in ("evidence", "available_tools", "permitted_tools"):
        c["input"].pop(name)
    c["gold"].pop("permitted_tools")
    c["gold"].pop("expected_tool_call")
    c["gold"]["expected_decision"] = "RESPOND"
    assert readers.read_cases(spark, write(tmp_path / "cases.json", [c])).count() == 1


def test_contracts_as_json_schema(spark, tmp_path):
    sinks.export_contracts(spark, str(tmp_path / "c"))
    files = sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.startswith("."))
    assert len(files) == 12
    one = json.loads((tmp_path / "c/eval_case.schema.json").read_text())
    assert one["additionalProperties"] is False and one["required"] == ["gold", "input", "license", "provenance", "review_status", "source"] and one["properties"]["input"]["properties"]["languages"]["minItems"] == 1


def test_case_folding(spark):
    some = ["Stra\u00dfe", "\u1e9eX", "\u039f\u0394\u039f\u03a3", "\ufb01n", "\u13a0\uab70", "\u0130", "Plain", "\u017fe", None]
    from gradewell.functions.canonical import folded

    got = [r["f"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(some)], "k int, t string").select("k", folded(F.col("t")).alias("f")).orderBy("k").collect()]
    assert got == [None if t is None else t.casefold() for t in some]


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    data = bytes(range(256)) * 20_000
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a b.bin").write_bytes(data)
    assert [tuple(r) for r in readers.file_digests(spark, str(tmp_path / "f")).collect()] == [("a b.bin", hashlib.sha256(data).hexdigest(), len(data))]


def test_what_is_no_json_is_not_published(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed"):
        sinks.write_lines(spark.createDataFrame([("{",)], "line string"), str(tmp_path / "x.json"), ["line"], True)
    assert not (tmp_path / "x.json").exists() and not list(tmp_path.glob("x.json.part*"))
