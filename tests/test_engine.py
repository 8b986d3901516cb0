"""Scoring, reports, tools, episodes, journals and rules on small tables made here."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from gradewell.functions import canonical as C
from gradewell.functions.prompt import prompt
from gradewell.operators import episodes, journal, reports, tools, validation
from gradewell.operators.attempts import attempts, forbidden, resume_faults, resume_plan, run_or_resume, select_cases
from gradewell.operators.scoring import score, with_gold

GOLD = "case_id string, expected_decision string, expected_answerability string, expected_tool string"
OUT = "case_id string, family_id string, pos int, raw_output string, failure string"


def say(decision, answerability="NOT_APPLICABLE", **more):
    import json

    return json.dumps({"decision": decision, "answerability": answerability} | more)


GET = {"tool": "get_record", "arguments": {"record_id": "r"}}
LOOK = {"tool": "lookup_status", "arguments": {"subject_id": "s"}}
CASES = [  # case, expected decision, answerability, tool, text, failure, labels of (action, answerability, schema, tool)
    ("ok", "RESPOND", "SUPPORTED", None, say("RESPOND", "SUPPORTED", answer="a"), None, ([], [], [], [])),
    ("missed", "CALL_TOOL", "NOT_APPLICABLE", "get_record", say("REFUSE", reason="r"), None, (["missed_call"], [], [], ["missed_call"])),
    ("needless", "REFUSE", "NOT_APPLICABLE", None, say("CALL_TOOL", tool_call=GET), None, (["unnecessary_call"], [], [], [])),
    ("wrong", "CALL_TOOL", "NOT_APPLICABLE", "get_record", say("CALL_TOOL", tool_call=LOOK), None, (["wrong_tool"], [], [], ["wrong_tool"])),
    ("right", "CALL_TOOL", "NOT_APPLICABLE", "get_record", say("CALL_TOOL", tool_call=GET), None, ([], [], [], [])),
    ("answer", "RESPOND", "SUPPORTED", None, say("RESPOND", "UNSUPPORTED", answer="a"), None, ([], ["wrong_answerability"], [], [])),
    ("broken", "CALL_TOOL", "NOT_APPLICABLE", "get_record", "{", None, (["parser_failure", "invalid_schema"],) * 4),
    ("late", "RESPOND", "SUPPORTED", None, None, "timeout", (["timeout"], ["timeout"], ["timeout"], [])),
    ("long", "CALL_TOOL", "SUPPORTED", "get_record", None, "context_overflow", (["overflow"],) * 4),
    ("dead", "RESPOND", "SUPPORTED", None, None, "error", (["incomplete_run"], ["incomplete_run"], ["incomplete_run"], [])),
    ("mute", "RESPOND", "SUPPORTED", None, None, None, (["incomplete_run"], ["incomplete_run"], ["incomplete_run"], [])),
]


@pytest.fixture(scope="module")
def run(spark):
    gold = spark.createDataFrame([c[:4] for c in CASES], GOLD)
    out = spark.createDataFrame([(c[0], "f", i, c[4], c[5]) for i, c in enumerate(CASES)], OUT)
    made = attempts(out, F.lit("run")).cache()
    return gold, out, made, score(with_gold(made, gold)).cache()


def test_scores(run):
    rows = {(r["case_id"], r["metric_id"]): r for r in run[3].collect()}
    assert len(rows) == 4 * len(CASES)
    for case, *_, labels in CASES:
        for metric, wanted in zip(("action_correct", "answerability_correct", "schema_valid", "tool_identity_correct"), labels, strict=True):
            assert rows[case, metric]["failure_labels"] == wanted, (case, metric)
    value = lambda c, m: (rows[c, m]["eligible"], rows[c, m]["value"], rows[c, m]["missing_reason"])
    assert value("late", "action_correct") == (True, 0.0, None)
    assert value("late", "schema_valid") == (False, None, "runtime_timeout")
    assert value("long", "schema_valid") == (False, None, "runtime_context_overflow")
    assert value("late", "tool_identity_correct") == (False, None, "not_tool_required")
    assert value("long", "tool_identity_correct") == (False, None, "runtime_context_overflow")
    assert value("broken", "tool_identity_correct") == (True, 0.0, None)
    assert value("right", "tool_identity_correct") == (True, 1.0, None)
    assert validation.violations(run[3], "case_id", validation.score_rules()).isEmpty()
    assert validation.violations(run[2], "case_id", validation.attempt_rules()).isEmpty()


def test_reports(run, spark):
    _, _, made, scores = run
    report = {r["metric_id"]: tuple(r)[1:] for r in reports.metric_report(scores).collect()}
    assert report["schema_valid"] == (11, 7, 4, 6 / 7)
    assert report["tool_identity_correct"] == (11, 4, 7, 0.25)
    none = reports.metric_report(scores.where("metric_id = 'schema_valid' AND case_id = 'late'")).first()
    assert none["estimate"] is None and none["eligible_instances"] == 0
    s = reports.run_summary(made, 11).first()
    assert (s["completed"], s["invalid_responses"], s["timeouts"], s["execution_errors"], s["balanced"]) == (6, 1, 1, 3, True)
    assert not reports.run_summary(made, 12).first()["balanced"]
    failed = {r["case_id"]: r for r in reports.failure_rows(made, scores).collect()}
    assert set(failed) == {c[0] for c in CASES} - {"ok", "right"}
    assert failed["broken"]["failure_labels"] == ["invalid_schema", "parser_failure"] and failed["broken"]["parse_error"] == "PARSE_ERROR"
    assert reports.case_order(made, ("run_id",)).first()["case_ids"] == [c[0] for c in CASES]


def test_resume(run, spark):
    gold, out, made, _ = run
    old = made.where("pos < 3")
    assert {r["case_id"]: r["action"] for r in resume_plan(out.select("case_id"), old).collect()} == {c[0]: "reuse" if i < 3 else "run" for i, c in enumerate(CASES)}
    again = run_or_resume(out, old, lambda todo: todo, F.lit("run"))
    assert sorted(map(str, again.select("attempt_id", "status").collect())) == sorted(map(str, made.select("attempt_id", "status").collect()))
    assert run_or_resume(out, made, forbidden, F.lit("run")).count() == len(CASES)
    with pytest.raises(Exception, match="replay asked"):
        run_or_resume(out, old, forbidden, F.lit("run")).collect()
    bad = made.select("case_id", F.when(F.col("pos") == 1, "x").otherwise(F.col("family_id")).alias("family_id"), F.when(F.col("pos") == 2, "other").otherwise(F.col("run_id")).alias("run_id"))
    bad = bad.union(bad.where("case_id = 'ok'")).union(spark.createDataFrame([("nobody", "f", "run")]))
    assert {tuple(r) for r in resume_faults(out, bad, "run").select("rule", "case_id").collect()} == {("other_family", "missed"), ("other_run", "needless"), ("repeated", "ok"), ("unknown_case", "nobody")}
    picked = select_cases(out.select("case_id"), spark.createDataFrame([("late", 0), ("none", 1)], "case_id string, pos int")).orderBy("pos").collect()
    assert [r["found"] for r in picked] == [True, False]


DAY = datetime.date


def test_tools(spark):
    records = spark.createDataFrame([("c", 0, "r1", "Große STRASSE", DAY(2024, 1, 1), True), ("c", 1, "r2", "grosse straße", DAY(2025, 1, 1), True), ("c", 2, "r1", "second", DAY(2025, 1, 1), False)], "case_id string, pos int, record_id string, text string, observed_at date, authoritative boolean")
    statuses = spark.createDataFrame([("c", 0, "s", "open", DAY(2024, 1, 1)), ("c", 1, "s", "shut", DAY(2025, 1, 1))], "case_id string, pos int, subject_id string, status string, observed_at date")
    faults = spark.createDataFrame([("d", 0, "get_record", "TIMEOUT"), ("d", 1, "get_record", "STALE_DATA")], "case_id string, pos int, tool string, error_code string")
    every = ["search_records", "get_record", "calculate", "lookup_status"]
    blank = {"query": None, "as_of_date": None, "limit": None, "record_id": None, "subject_id": None, "operation": None, "left": None, "right": None}
    asked = [
        ("1", "c", "search_records", every, every, {"query": "STRAßE"}), ("2", "c", "search_records", every, every, {"query": "strasse", "as_of_date": DAY(2024, 6, 1)}), ("3", "c", "search_records", every, every, {"query": "none"}), ("4", "c", "search_records", every, every, {"query": "s", "limit": 1}),
        ("5", "c", "get_record", every, every, {"record_id": "r1"}), ("6", "c", "get_record", every, every, {"record_id": "rx"}), ("7", "c", "lookup_status", every, every, {"subject_id": "s"}), ("8", "c", "calculate", every, every, {"operation": "divide", "left": 10.0, "right": 0.0}),
        ("9", "c", "calculate", every, every, {"operation": "multiply", "left": 1e308, "right": 10.0}), ("10", "c", "calculate", every, every, {"operation": "divide", "left": 10.0, "right": 4.0}), ("11", "d", "get_record", every, every, {"record_id": "r1"}), ("12", "d", "get_record", every, [], {"record_id": "r1"}), ("13", "d", "get_record", [], [], {"record_id": "r1"}),
    ]
    schema = "call_id string, case_id string, tool string, available array<string>, permitted array<string>, query string, as_of_date date, limit int, record_id string, subject_id string, operation string, left double, right double"
    calls = spark.createDataFrame([(*a[:5], *(blank | a[5]).values()) for a in asked], schema)
    got = {r["call_id"]: r for r in tools.simulate(calls, records, statuses, faults).collect()}
    assert len(got) == len(asked)
    errors = {k: r["error_code"] for k, r in got.items() if not r["success"]}
    assert errors == {"6": "NOT_FOUND", "8": "ARGUMENT_INVALID", "9": "ARGUMENT_INVALID", "11": "TIMEOUT", "12": "PERMISSION_DENIED", "13": "INVALID_TOOL"}
    assert got["1"]["payload"].index("r2") < got["1"]["payload"].index("r1") and "second" not in got["1"]["payload"]
    assert "r2" not in got["2"]["payload"] and got["3"]["payload"] == '{"kind":"search_records","records":[]}' and got["4"]["payload"].count("record_id") == 1
    assert got["5"]["payload"] == '{"kind":"get_record","record":{"authoritative":true,"observed_at":"2024-01-01","record_id":"r1","text":"Große STRASSE"}}'
    assert '"status":"open"' in got["7"]["payload"] and got["10"]["payload"] == '{"kind":"calculate","result":2.5}'
    assert validation.violations(tools.simulate(calls, records, statuses, faults), "call_id", validation.result_rules()).isEmpty()


EPISODES = {
    "done": (["answer"], ("completed", 1, 0, 0)), "tool": (["call", "answer"], ("completed", 2, 1, 0)), "third": (["call", "call", "call"], ("budget_exhausted", 3, 2, 0)), "repaired": (["invalid", "answer"], ("completed", 2, 0, 1)),
    "twice": (["invalid", "invalid", "answer"], ("budget_exhausted", 2, 0, 1)), "open": (["call"], ("open", 1, 1, 0)), "turns": (["call", "invalid", "call", "call", "answer"], ("budget_exhausted", 4, 2, 1)),
}


def test_episodes(spark):
    turns = spark.createDataFrame([(c, i, k) for c, (kinds, _) in EPISODES.items() for i, k in enumerate(kinds)], "case_id string, turn_index int, kind string")
    wanted = {c: w for c, (_, w) in EPISODES.items()}
    assert {r["case_id"]: (r["terminal_status"], r["turns_used"], r["calls_used"], r["repairs_used"]) for r in episodes.terminal_states(turns).collect()} == wanted
    rows = spark.createDataFrame([(c, kinds) for c, (kinds, _) in EPISODES.items()], "case_id string, kinds array<string>").select("case_id", episodes.fold(F.col("kinds")).alias("s"))
    assert {r["case_id"]: tuple(r["s"]) for r in rows.collect()} == wanted
    calls = spark.createDataFrame([("c", 0, 1, "a"), ("c", 1, 1, "a"), ("c", 2, 2, "a"), ("c", 3, 1, "b")], "case_id string, pos int, state_version int, call string")
    assert [r["verdict"] for r in episodes.tracked(calls, 2).orderBy("pos").collect()] == ["ok", "stagnation", "budget_exhausted", "budget_exhausted"]
    tokens = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.2)], "token int, p double")
    assert {r["token"] for r in episodes.nucleus(tokens, 0.6).collect()} == {1, 2}


def test_journal(spark):
    table = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id string")
    got = journal.journal_states(table("a", "b", "c", "d"), table("b", "c", "x"), table("c", "d"))
    assert {r["case_id"]: r["state"] for r in got.collect()} == {"a": "run", "b": "unresolved", "c": "reuse", "d": "receipt_without_intent", "x": "unknown_case"}
    one = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    two = spark.createDataFrame([("a", "2"), ("b", None), ("d", "4")], "k string, v string")
    assert {tuple(r) for r in journal.differences(one, two, "k", ["v"]).collect()} == {("a", "v", "1", "2"), ("c", "row", "present", "missing"), ("d", "row", "missing", "present")}
    pos = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "pos int, case_id string")
    assert journal.positions_differ(pos("a", "b"), pos("a", "b")).isEmpty() and journal.positions_differ(pos("a", "b"), pos("b", "a", "c")).count() == 3
    receipts = spark.createDataFrame([("a", "x")], "case_id string, attempt string")
    assert journal.rebuilt(table("a"), receipts).count() == 1
    with pytest.raises(Exception, match="no receipt for case b"):
        journal.rebuilt(table("a", "b"), receipts).collect()


def test_rules(spark):
    rows = spark.createDataFrame([(1, 0, 0), (0, 1, 1)], "max_turns int, max_calls int, max_repairs int").withColumn("key", F.monotonically_increasing_id())
    assert validation.violations(rows, "max_turns", validation.policy_rules()).collect()[0]["key"] == "0"
    bad = spark.createDataFrame([(0, 1.0, 0.5), (1, 0.0, 0.5), (1, 1.0, 1.5), (1, 1.0, 1.0)], "max_new_tokens int, temperature double, top_p double")
    assert validation.violations(bad, "top_p", validation.generation_rules()).count() == 3
    one = spark.range(1).select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("n"))
    assert one.select(validation.equal("x", F.col("n"), F.lit(None).cast("int"))).first()[0]
    with pytest.raises(Exception, match="x differs"):
        one.select(validation.equal("x", F.col("a"), F.col("n"))).collect()
    assert validation.exactly_one(one, "one").count() == 1
    with pytest.raises(Exception, match="not exactly one"):
        validation.exactly_one(spark.range(2), "two").collect()
    with pytest.raises(ValueError, match="V20"):
        validation.refuse(validation.repeated(spark.createDataFrame([("a",), ("a",)], "k string"), "k"))


def test_prompt_and_canonical(spark):
    row = spark.sql("SELECT array(named_struct('content', 'hi', 'role', 'user')) AS m, filter(array(named_struct('content', 'c', 'document_id', 'd')), x -> false) AS e, array('a', 'b') AS t, array() AS p")
    text = row.select(prompt(F.col("m"), F.col("e"), F.col("t"), F.col("p").cast("array<string>"), F.array(F.lit('{"x":1}')))).first()[0]
    assert text.endswith('MESSAGES\nuser: hi\n\nEVIDENCE\nnone\n\nAVAILABLE_TOOLS=["a", "b"]\nPERMITTED_TOOLS=[]\n\nTOOL_RESULTS\n{"x":1}\n<reserved_1>\n')
    one = spark.range(1)
    assert one.select(C.canonical(F.struct(F.lit("ü").alias("a"), F.lit(None).cast("string").alias("b")))).first()[0] == '{"a":"ü"}'
    assert one.select(C.folded(F.lit("STRAßE"))).first()[0] == "strasse"
    assert one.select(C.tokens_per_second(F.lit(0), F.lit(1.0)), C.tokens_per_second(F.lit(4), F.lit(2.0))).first() == (0.0, 2.0)
    assert one.select(C.safe_name(F.lit("a-b.c")), C.safe_name(F.lit("..")), C.safe_name(F.lit("a/b"))).first() == (True, False, False)
    assert one.select(C.run_id("p", F.lit("0123456789abcdef"), 12)).first()[0] == "p-0123456789ab"
