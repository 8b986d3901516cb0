"""Whole episodes, models as functions and as children, and the gate over a bundle."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark.sql import functions as F

from gradewell.functions.prompt import prompt
from gradewell.operators import gates, models, reports
from gradewell.operators.attempts import attempts
from gradewell.operators.episode_runs import run_episodes
from gradewell.operators.scoring import score, score_records, with_gold
from gradewell.operators.validation import observation_rules, violations
from gradewell.sources import sinks

ANSWER = json.dumps({"decision": "RESPOND", "answerability": "SUPPORTED", "answer": "done"})
CALL = json.dumps({"decision": "CALL_TOOL", "answerability": "NOT_APPLICABLE", "tool_call": {"tool": "get_record", "arguments": {"record_id": "r"}}})
SUM = json.dumps({"decision": "CALL_TOOL", "answerability": "NOT_APPLICABLE", "tool_call": {"tool": "calculate", "arguments": {"operation": "add", "left": 1, "right": 2}}})
# case: what the model says by turns; status, turns, calls, repairs; error codes of its results
EPISODES = {
    "tool": ([CALL, ANSWER], ("completed", 2, 1, 0), [None]), "denied": ([SUM, ANSWER], ("completed", 2, 1, 0), ["PERMISSION_DENIED"]), "third": ([CALL, SUM, CALL], ("budget_exhausted", 3, 2, 0), [None, "PERMISSION_DENIED"]),
    "repaired": (["{", ANSWER], ("completed", 2, 0, 1), []), "twice": (["{", " "], ("budget_exhausted", 2, 0, 1), []), "turns": ([CALL, "{", CALL, "x"], ("budget_exhausted", 4, 2, 1), [None, None]), "once": ([ANSWER], ("completed", 1, 0, 0), []),
    "long": (["{", CALL, CALL, CALL], ("budget_exhausted", 4, 2, 1), [None, None]),
}


def test_episodes(spark):
    said = spark.createDataFrame([(c, texts) for c, (texts, _, _) in EPISODES.items()], "case_id string, texts array<string>")
    cases = said.select("case_id", F.lit(0).alias("n"), F.array(F.lit("get_record"), F.lit("calculate")).alias("available"), F.array(F.lit("get_record")).alias("permitted"), "texts")

    def model(asked):
        """Says the next text: as many as there were results and repairs are behind it."""
        before = F.size("results") + F.when(F.col("case_id").isin("turns"), F.when(F.size("results") > 1, 1).otherwise(0)).when(F.col("case_id") == "long", F.when(F.size("results") > 0, 1).otherwise(0)).otherwise(0) + F.when(F.col("repairing"), 1).otherwise(0)
        return asked.select("case_id", F.element_at("texts", (before + 1).cast("int")).alias("raw_output"))

    records = spark.createDataFrame([(c, 0, "r", "text", None, True) for c in EPISODES], "case_id string, pos int, record_id string, text string, observed_at date, authoritative boolean")
    empty = lambda schema: spark.createDataFrame([], schema)
    done, turns, results = run_episodes(cases, model, records, empty("case_id string, pos int, subject_id string, status string, observed_at date"), empty("case_id string, pos int, tool string, error_code string"))
    got = {r["case_id"]: r for r in done.collect()}
    assert {c: (r["terminal_status"], r["turns"], r["calls"], r["repairs"]) for c, r in got.items()} == {c: w for c, (_, w, _) in EPISODES.items()}
    assert got["once"]["response"]["answer"] == "done" and got["twice"]["parse_failure"]["code"] == "PARSE_ERROR" and got["twice"]["error_code"] == "BUDGET_EXHAUSTED"
    codes = {}
    for r in sorted(results.collect(), key=lambda r: r["call_id"]):
        codes.setdefault(r["case_id"], []).append(r["error_code"])
    assert codes == {c: w for c, (_, _, w) in EPISODES.items() if w}
    assert [r["kind"] for r in turns.where("case_id = 'repaired'").orderBy("turn_index").collect()] == ["generate", "repair"]
    assert turns.count() == sum(w[1] for _, w, _ in EPISODES.values())


def typed():
    """A model; defined inside, so that workers get its code."""
    answer = ANSWER

    def model_of(case):
        kind = case["case_id"]
        if kind == "late":
            raise models.ModelTimeout
        if kind == "long":
            raise models.ContextOverflow
        if kind == "spent":
            raise models.BudgetExhausted
        if kind == "dead":
            raise models.ModelError
        if kind == "bug":
            raise KeyError("bug")
        return 5 if kind == "number" else answer

    return model_of


def test_typed_errors(spark):
    cases = spark.createDataFrame([(c, "f") for c in ("ok", "late", "long", "spent", "dead", "number")], "case_id string, family_id string")
    made = attempts(models.calling(typed())(cases), F.lit("r"))
    assert {r["case_id"]: (r["status"], r["runtime_error_code"]) for r in made.collect()} == {
        "ok": ("completed", None), "late": ("timeout", "TIMEOUT"), "long": ("execution_error", "CONTEXT_OVERFLOW"), "spent": ("execution_error", "BUDGET_EXHAUSTED"), "dead": ("execution_error", "EXECUTION_ERROR"), "number": ("execution_error", "EXECUTION_ERROR"),
    }
    with pytest.raises(Exception, match="bug"):
        models.calling(typed())(spark.createDataFrame([("bug", "f")], "case_id string, family_id string")).collect()


WORKER = """
import json, sys, time
case = json.load(sys.stdin)
out = {"case_id": case, "raw_output": "text", "model_inference_seconds": 0.5, "input_token_count": 3, "output_token_count": 1, "stop_reason": "eos", "prompt_sha256": "h", "input_ids": [1, 2, 3], "generated_ids": [4], "runtime_device": "cpu", "parameter_dtype": "f", "attention_mode": "a", "model_load_seconds": 0.1}
if case == "late": time.sleep(30)
if case == "exit": sys.exit(3)
if case == "other": out["case_id"] = "x"
if case == "extra": out["more"] = 1
print("{" if case == "torn" else json.dumps(out))
"""


def test_children(spark):
    cases = spark.createDataFrame([(c, "f") for c in ("ok", "late", "exit", "other", "extra", "torn")], "case_id string, family_id string").coalesce(1)
    got = models.in_children([sys.executable, "-c", WORKER], lambda c: json.dumps(c["case_id"]), 3.0)(cases).cache()
    assert {r["case_id"]: (r["raw_output"], r["failure"], r["observation"]["transport_status"], r["observation"]["worker_returncode"]) for r in got.collect()} == {
        "ok": ("text", None, "completed", 0), "late": (None, "timeout", "timeout", None), "exit": (None, "error", "execution_error", 3), "other": (None, "error", "execution_error", 0), "extra": (None, "error", "execution_error", 0), "torn": (None, "error", "execution_error", 0),
    }
    assert got.where("case_id = 'ok'").first()["observation"]["input_ids"] == [1, 2, 3] and got.where("case_id = 'torn'").first()["worker_stdout"] == "{\n"
    assert violations(got.select("observation.*"), "case_id", observation_rules()).isEmpty()
    lost = models.run_child(["/no/such/worker"], "", "c", 1.0)
    assert lost["failure"] == "error" and lost["observation"]["worker_returncode"] is None and lost["worker_stderr"]


def test_gate(spark, tmp_path):
    outputs = spark.createDataFrame([("a", "f", ANSWER, None), ("b", "f", "{", None)], "case_id string, family_id string, raw_output string, failure string")
    gold = spark.createDataFrame([("a", "RESPOND", "SUPPORTED", None), ("b", "RESPOND", "SUPPORTED", None)], "case_id string, expected_decision string, expected_answerability string, expected_tool string")
    made = attempts(outputs, F.lit("r"))
    scores = score(with_gold(made, gold))
    one = spark.range(1).select(F.lit(1).alias("a"))
    timing = sinks.timing_reference(made)
    sinks.write_pilot_bundle(
        spark, str(tmp_path / "b"), manifest=one, receipts=made, scores=score_records(scores, F.lit("d"), F.lit("m"), "s", F.lit("harness_only")), metrics=reports.metric_report(scores), failures=reports.failure_rows(made, scores, gold), timing=timing,
        report=reports.report_lines(reports.metric_report(scores), reports.failure_rows(made, scores, gold)),
    )
    names = {"run_manifest.json", "case_receipts.jsonl", "scores.jsonl", "metrics.json", "failures.jsonl", "timing.csv", "BASELINE_REPORT.md"}
    assert gates.bundle_faults(spark, str(tmp_path / "b"), names).isEmpty()
    metrics = tmp_path / "b/metrics.json"
    (tmp_path / "b/.metrics.json.crc").unlink(missing_ok=True)
    metrics.write_text(metrics.read_text().replace("0.5", "0.75"))
    assert {r["rule"] for r in gates.bundle_faults(spark, str(tmp_path / "b"), names | {"more"}).collect()} == {"file_mismatch", "file_set", "metric_estimate"}
    tensors = spark.createDataFrame([("x", [2, 3], "f", "cpu"), ("y", [4], "f", "cpu")], "name string, shape array<int>, dtype string, device string")
    assert tuple(gates.tensor_totals(tensors).first()) == (10, ["f"], ["cpu"])


def test_results_reach_the_prompt(spark):
    row = spark.range(1).select(prompt(F.array(F.struct(F.lit("hi").alias("content"), F.lit("user").alias("role"))), F.array(F.struct(F.lit("c").alias("content"), F.lit("d").alias("document_id"))), F.array(F.lit("a")), F.array(F.lit("a")), F.array(F.lit("{}"), F.lit("[]"))))
    assert "EVIDENCE\nd: c\n" in row.first()[0] and "TOOL_RESULTS\n{}\n[]\n<reserved_1>" in row.first()[0]
