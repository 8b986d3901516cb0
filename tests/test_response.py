"""The strict parser: codes, their ranks, lax values, JSON syntax."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewell.functions.response import with_response
from plain_parser import parse_text


def respond(**more):
    return json.dumps({"decision": "RESPOND", "answerability": "SUPPORTED", "answer": "x"} | more)


def call(tool="get_record", arguments=None, **more):
    return json.dumps({"decision": "CALL_TOOL", "answerability": "NOT_APPLICABLE", "tool_call": {"tool": tool, "arguments": {"record_id": "r"} if arguments is None else arguments}} | more)


CODES = [
    ("", "PARSE_ERROR"), (" \n\t ", "PARSE_ERROR"), ("{", "PARSE_ERROR"), ("[]", "PARSE_ERROR"), ("1", "PARSE_ERROR"), ("null", "PARSE_ERROR"),
    (respond(), None), (respond(more=1), "UNKNOWN_FIELD"), (respond(answer=""), "PARSE_ERROR"), (respond(answer=" "), None), (respond(answer=1), "PARSE_ERROR"), (respond(claims=None), "PARSE_ERROR"),
    (respond(claims=[{"claim": "c", "more": 1}]), "UNKNOWN_FIELD"), (respond(claims=[{"claim": "c", "evidence_refs": ["d"]}], citations=["d"]), None), (respond(citations=[""]), "PARSE_ERROR"), (respond(decision="respond", more=1), "PARSE_ERROR"),
    (respond(answerability="supported"), "PARSE_ERROR"), (respond(schema_version="2.0"), "PARSE_ERROR"), (respond(decision=None), "PARSE_ERROR"), (respond(tool_call=None), "UNKNOWN_FIELD"),
    (call(), None), (call("fly"), "INVALID_TOOL"), (call("fly", more=1), "UNKNOWN_FIELD"), (call(arguments={}), "ARGUMENT_INVALID"), (call(arguments=[]), "ARGUMENT_INVALID"), (call(arguments={"record_id": "r", "x": 1}), "UNKNOWN_FIELD"),
    (call(tool_call=None), "PARSE_ERROR"), (call(tool_call="x"), "PARSE_ERROR"), (call(tool_call={"arguments": {}}), "PARSE_ERROR"), (call(tool_call={"tool": "get_record"}), "ARGUMENT_INVALID"),
    (json.dumps({"decision": "CALL_TOOL", "answerability": "SUPPORTED"}), "PARSE_ERROR"),
    (respond() + "x", "PARSE_ERROR"), ("{'a':1}", "PARSE_ERROR"), ('{"decision":"RESPOND","decision":"REFUSE","answerability":"SUPPORTED","reason":"r"}', None), (f" {respond()}\n", None), ("﻿" + respond(), "PARSE_ERROR"),
    ('{"decision":"RESPOND","answerability":"SUPPORTED","answer":"x","more":NaN}', "UNKNOWN_FIELD"), ("NaN", "PARSE_ERROR"),
]


@pytest.mark.parametrize(("raw", "code"), CODES)
def test_codes(raw, code):
    assert parse_text(raw)[1] == code


def argument(tool, **arguments):
    response, code, _ = parse_text(call(tool, arguments))
    return code or response["tool_call"]["arguments"]


@pytest.mark.parametrize(("value", "wanted"), [(10, 10.0), ("10", 10.0), (True, 1.0), (1.5, 1.5), (None, None), ("abc", None), (float("nan"), None), (float("inf"), None), ([1], None)])
def test_numbers_are_lax(value, wanted):
    got = argument("calculate", operation="add", left=value, right=1)
    assert got == ("ARGUMENT_INVALID" if wanted is None else {"operation": "add", "left": wanted, "right": 1.0})


@pytest.mark.parametrize(("value", "wanted"), [(5, 5), (5.0, 5), ("5", 5), (" 5 ", 5), (True, 1), (5.5, None), (11, None), (0, None), (None, None), ("x", None)])
def test_limits_are_lax(value, wanted):
    got = argument("search_records", query="q", limit=value)
    assert got == "ARGUMENT_INVALID" if wanted is None else got["limit"] == wanted


@pytest.mark.parametrize(("value", "wanted"), [("2024-12-31", "2024-12-31"), ("2024-12-31T00:00:00", "2024-12-31"), (0, "1970-01-01"), (86400, "1970-01-02"), ("1704067200", "2024-01-01"), ("2024-12-31T01:00:00", None), ("20241231", None), ("2024-02-30", None), (1.5, None)])
def test_days_are_lax(value, wanted):
    got = argument("search_records", query="q", as_of_date=value)
    assert got == "ARGUMENT_INVALID" if wanted is None else got["as_of_date"] == wanted


def test_defaults_and_bounds():
    assert argument("search_records", query="q") == {"query": "q", "as_of_date": None, "limit": 5}
    assert argument("search_records", query="q" * 501) == "ARGUMENT_INVALID"
    assert argument("search_records", query="") == "ARGUMENT_INVALID"
    assert parse_text(respond())[0] == {"decision": "RESPOND", "schema_version": "1.0", "status": "OK", "answerability": "SUPPORTED", "answer": "x", "claims": [], "citations": []}


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["decision", "answerability", "tool_call", "tool", "arguments", "answer", "claims"]) | st.text(max_size=3), x, max_size=4)))
def test_anything_gets_a_code_or_a_response(value):
    response, code, _ = parse_text(json.dumps(value))
    assert (response is None) != (code is None)


SCALARS = [None, True, False, 0, 1, 5, 10, 11, 5.0, 5.5, -1, 86400, 1704067200, 1704067200000, 10**30, 1e400, float("nan"), "", " ", "x", "5", " 5 ", "5.0", "5.", "+3", "1e3", ".5", "1_0", "abc", "2024-12-31", "2024-02-30", "0000-01-01", "2024-12-31T00:00:00Z", "2024-12-31 00:00",
           "2024-12-31\n", "20241231", "1704067200", "-86400", "86400.0", "q" * 501, "add", "OK", "1.0", "SUPPORTED", "RESPOND", "get_record", [], {}, [""], ["d"], [1], {"claim": "c"}, [{"claim": "c", "evidence_refs": ["d"]}], [{"claim": "", "x": 1}], [{"claim": "c", "evidence_refs": [None]}], [[]]]


def odd_texts():
    """Every field of every decision and tool with every one of these values, alone and beside an unknown field, and what is no JSON."""
    import random

    rng = random.Random(1)
    arguments = {"search_records": {"query": "q"}, "get_record": {"record_id": "r"}, "calculate": {"operation": "add", "left": 1, "right": 2}, "lookup_status": {"subject_id": "s"}}
    whole = [("RESPOND", {"answer": "x"}), ("ASK_CLARIFICATION", {"question": "q"}), ("REFUSE", {"reason": "r"})] + [("CALL_TOOL", {"tool_call": {"tool": t, "arguments": a}}) for t, a in arguments.items()]
    for decision, own in whole:
        base = {"decision": decision, "answerability": "SUPPORTED", **own}
        for name in ("decision", "answerability", "schema_version", "status", "answer", "claims", "citations", "question", "reason", "tool_call", "more"):
            for value in SCALARS:
                yield json.dumps(base | {name: value} | ({"extra": 1} if rng.random() < 0.1 else {}))
            yield json.dumps({k: v for k, v in base.items() if k != name})
        if decision == "CALL_TOOL":
            call_ = own["tool_call"]
            for value in SCALARS:
                for name in ("query", "as_of_date", "limit", "record_id", "operation", "left", "right", "subject_id", "more"):
                    yield json.dumps(base | {"tool_call": call_ | {"arguments": call_["arguments"] | {name: value}}})
                yield json.dumps(base | {"tool_call": call_ | {"arguments": value}})
                yield json.dumps(base | {"tool_call": call_ | {"tool": value}})
                yield json.dumps(base | {"tool_call": call_ | {"more": value}})
    yield from ("[" * 20000, '{"a":' * 500 + "1" + "}" * 500, "1" * 5000, '{"decision":"REFUSE","answerability":"SUPPORTED","reason":"\\ud83d\\ude00 \\u0000"}', "\x1c", "\u3000", "\u200b")


def test_spark_agrees(spark):
    """With the plain parser on all of these: codes, and responses to the last value."""
    texts = [raw for raw, _ in CODES] + list(odd_texts()) + [None]
    got = with_response(spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(4), F.col("raw"), "p").collect()
    clean = lambda x: {k: clean(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else x
    valid = 0
    for r in got:
        response, code, message = parse_text(r["raw"]) if r["raw"] is not None else (None, None, None)
        p = r["p"].asDict(recursive=True) if r["p"] else {"response": None, "failure": None}
        assert (p["failure"] or {}).get("code") == code, (r["raw"], p)
        assert (p["failure"] or {}).get("message") == message, (r["raw"], p)
        assert clean(p["response"]) == clean(response), r["raw"]
        valid += response is not None
    assert len(got) > 5000 and valid > 300
