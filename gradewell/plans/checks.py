"""Queries over row rules, contracts, gates, simulated tools, whole episodes, and files that are written and read again; with their SQL.

Rows come from the driver's tables; what is wrong with a row follows from its number, so SQL can say it without reading what is checked."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.contracts import json_schema
from gradewell.functions import canonical as C
from gradewell.operators import attempts as A
from gradewell.operators import episode_runs, episodes, gates, identity, journal, models, reports, tools, validation
from gradewell.operators.scoring import labelled, score, score_records, with_gold
from gradewell.plans.derived import cases, outputs, pick, table
from gradewell.plans.oracles import _BASE, _EPISODES, _METRICS
from gradewell.schemas import ATTEMPT_STATUSES, FAULT, TOOLS
from gradewell.sources import readers, sinks
from gradewell.sources.arrays import array_items
from gradewell.sources.places import shared_folder, until_exit, written
from gradewell.streaming import runs

def _n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, with its number."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("case_id"))


def _if(k: int, value) -> Column:
    """value where n divides by k, null elsewhere."""
    return F.when(F.col("n") % k == 0, value if isinstance(value, Column) else F.lit(value))


def _unless(k: int, right, wrong) -> Column:
    """wrong where n divides by k, right elsewhere."""
    return F.when(F.col("n") % k == 0, F.lit(wrong) if not isinstance(wrong, Column) else wrong).otherwise(F.lit(right) if not isinstance(right, Column) else right)


def _every(rules: dict[str, str], key: str, of: str) -> str:
    """SQL: a row for each rule whose condition holds."""
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, {key} AS key FROM {of} WHERE {when}" for rule, when in rules.items())


def attempt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _n(spark, sf_dir).select("case_id", pick(ATTEMPT_STATUSES, F.col("n") % 4).alias("status"), _if(2, "x").alias("raw_output"), _if(3, "x").alias("parsed_response"), _if(5, "x").alias("parse_failure"), F.coalesce(_if(14, "TIMEOUT"), _if(7, "EXECUTION_ERROR")).alias("runtime_error_code"))
    return validation.violations(rows, "case_id", validation.attempt_rules())


def score_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("n") % 11 == 0, float("nan")).when(F.col("n") % 13 == 0, float("inf")).when(F.col("n") % 3 != 0, 1.0)
    return validation.violations(_n(spark, sf_dir).select("case_id", value.alias("value"), _if(2, "why").alias("missing_reason")), "case_id", validation.score_rules())


def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = _n(spark, sf_dir).select(
        "case_id", pick(("completed", "timeout", "execution_error"), n % 3).alias("transport_status"), F.lit("2026-01-15T12:00:00+00:00").alias("started_at_utc"), F.when(n % 5 == 0, "2026-01-15T13:00:00+02:00").when(n % 7 == 0, "2026-01-15T12:00:01").otherwise("2026-01-15T14:00:00+01:00").alias("completed_at_utc"),
        F.when(n % 2 == 0, F.lit(0)).when(n % 11 == 0, F.lit(1)).alias("worker_returncode"), F.lit(0.5).alias("model_inference_seconds"), F.lit(3).alias("input_token_count"), F.lit(1).alias("output_token_count"), F.lit("eos").alias("stop_reason"), F.when(n % 13 != 0, "h").alias("prompt_sha256"),
        pick(("1.0", "1.1"), n % 4 % 2).alias("schema_version"), F.array(F.lit(1)).alias("input_ids"), F.array(F.lit(2)).alias("generated_ids"), F.when(n % 17 != 0, "d").alias("runtime_device"), F.lit("t").alias("parameter_dtype"), F.lit("a").alias("attention_mode"), F.when(n % 4 != 2, 0.25).alias("model_load_seconds"),
    )
    return validation.violations(rows, "case_id", validation.observation_rules())


def result_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _n(spark, sf_dir).select("case_id", (F.col("n") % 2 == 0).alias("success"), _if(3, "NOT_FOUND").alias("error_code"), F.when(F.col("n") % 5 < 3, "{}").alias("payload"), F.when(F.col("n") % 7 < 5, "h").alias("payload_hash"))
    return validation.violations(rows, "case_id", validation.result_rules())


def episode_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _n(spark, sf_dir).select("case_id", pick(("completed", "invalid_response", "budget_exhausted", "stagnation"), F.col("n") % 4).alias("terminal_status"), _if(3, "r").alias("response"), _if(5, "f").alias("parse_failure"), _if(2, "e").alias("error_code"))
    return validation.violations(rows, "case_id", validation.episode_rules())


def receipt_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.struct(F.col("case_id"))
    rows = _n(spark, sf_dir).select("case_id", F.lit("run").alias("run_id"), F.struct("case_id", _unless(3, "run", "other").alias("run_id")).alias("attempt"), F.struct(_unless(5, F.col("case_id"), "x").alias("case_id")).alias("observation"), F.when(F.col("n") % 7 != 0, own).alias("diagnostics"))
    return validation.violations(rows, "case_id", validation.receipt_rules())


def bound_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _n(spark, sf_dir).select("case_id", (F.col("n") % 3).alias("max_turns"), (F.col("n") % 5 - 1).alias("max_calls"), F.lit(0).alias("max_repairs"), (F.col("n") % 7).alias("max_new_tokens"), (F.col("n") % 4 / 4).alias("temperature"), (F.col("n") % 6 / 4).alias("top_p"))
    return validation.violations(rows, "case_id", validation.policy_rules() | validation.generation_rules())


def _full_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cases as JSON, some with a fault."""
    n = F.col("n")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    message = F.concat(F.lit('{"role":'), _unless(11, '"user"', '"robot"'), F.lit(',"content":"hi"}'))
    input_ = F.concat(
        F.lit('{"case_id":'), text(F.col("case_id")), F.lit(',"family_id":'), _unless(5, '"f"', '""'), F.lit(',"languages":'), _unless(7, '["en"]', "[]"), F.lit(',"messages":['), message, F.lit('],"available_tools":["get_record"],"permitted_tools":["get_record"]'),
        _unless(13, ',"evaluation_time_utc":"2026-01-15T12:00:00Z"', ""), _unless(17, "", ',"more":1'), F.lit("}"),
    )
    gold = F.concat(
        F.lit('{"case_id":'), text(F.col("case_id")), F.lit(',"expected_decision":'), _unless(3, '"CALL_TOOL"', '"FLY"'), F.lit(',"expected_answerability":"NOT_APPLICABLE","permitted_tools":["get_record"],"expected_tool_call":{"tool":"get_record","arguments":{'), _unless(19, '"record_id":"r"', '"id":"r"'),
        F.lit('}},"rubric":"x"}'),
    )
    tail = F.concat(_unless(23, ',"split":"development_pilot"', ',"split":"test"'), _unless(29, ',"license":"l"', ""), F.lit(',"source":"s","provenance":"p","review_status":"r"}'))
    return _n(spark, sf_dir).select("case_id", n, F.concat(F.lit('{"input":'), input_, F.lit(',"gold":'), gold, tail).alias("json"))


_CASE_FAULTS = {
    "invalid gold.expected_decision": 3, "invalid input.family_id": 5, "invalid input.languages": 7, "invalid input.messages[0].role": 11, "missing input.evaluation_time_utc": 13, "unknown input.more": 17,
    "unknown gold.expected_tool_call.arguments.id": 19, "missing gold.expected_tool_call.arguments.record_id": 19, "invalid split": 23, "missing license": 29,
}


def case_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.case_faults(_full_cases(spark, sf_dir), "case_id", "json")


def contract_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported schemas of a case and its two parts against all cases: each field that is declared, or that cases have, with whether it
    is declared, whether it is required, and how many cases have it."""
    parts = {"eval_case": "$", "eval_input": "$.input", "eval_gold": "$.gold"}
    made = spark.createDataFrame([(n, json_schema(n)) for n in parts], "contract string, text string")
    required = F.coalesce(F.from_json(F.get_json_object("text", "$.required"), "array<string>"), F.array().cast("array<string>"))
    declared = made.select("contract", F.explode(F.map_keys(F.from_json(F.get_json_object("text", "$.properties"), "map<string,string>"))).alias("field"), required.alias("r"))
    declared = declared.select("contract", "field", F.array_contains("r", F.col("field")).alias("required"), F.lit(True).alias("declared"))
    keys = F.array(*[F.struct(F.lit(n).alias("contract"), F.json_object_keys(F.get_json_object("json", path)).alias("fields")) for n, path in parts.items()])
    found = _full_cases(spark, sf_dir).select(F.explode(keys).alias("k")).select("k.contract", F.explode("k.fields").alias("field")).groupBy("contract", "field").agg(F.count("*").alias("n_cases"))
    return declared.join(found, ["contract", "field"], "full_outer").select("contract", "field", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("required", F.lit(False)).alias("required"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def run_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's summary against the number of cases it should have; run-2 has an attempt twice, and run-1 one case less."""
    made = A.attempts(outputs(cases(spark, sf_dir)), F.col("run_id")).select("run_id", "case_id", "pos", "status")
    first = made.where("run_id = 'run-2'").orderBy("pos").limit(1)
    known = cases(spark, sf_dir).groupBy("run_id").agg((F.count("*") - F.when(F.col("run_id") == "run-1", 1).otherwise(0)).alias("expected_cases"))
    return reports.run_summary(made.union(first), known).select("run_id", "attempted_cases", "balanced")


def summary_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = A.attempts(outputs(cases(spark, sf_dir)), F.col("run_id")).select("run_id", "case_id", "status")
    n = made.where("run_id = 'run-0'").count()
    return reports.run_summary(made, n).select("run_id", "expected_cases", "balanced")


def case_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.case_order(cases(spark, sf_dir).withColumn("pos", -F.col("pos")), ("family_id",)).select("family_id", F.array_join("case_ids", ",").alias("case_ids"))


def tensor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", F.array(F.col("p_size").cast("long"), F.lit(64).cast("long")).alias("shape"), pick(("bf16", "f32"), F.col("p_partkey") % 2).alias("dtype"), F.lit("cpu").alias("device"))
    return gates.tensor_totals(p).select("parameters", F.array_join("dtypes", ",").alias("dtypes"), F.array_join("devices", ",").alias("devices"))


def nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as tokens; their masses are 64ths, so sums are exact."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("token"), ((F.col("l_quantity").cast("int") % 16 + 1) / 64).alias("p"))
    return episodes.nucleus(t, 0.25, ("l_orderkey",))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    call = F.struct(F.struct(F.col("family_id").alias("record_id"), F.lit(None).cast("string").alias("subject_id")).alias("arguments"), F.lit("get_record").alias("tool"))
    odd = F.when(F.col("k") % 5 == 0, F.concat(F.lit("../"), "case_id")).when(F.col("k") % 7 == 0, "..").otherwise(F.concat(F.lit("a.b-"), "case_id"))
    return c.select(
        "case_id", C.run_id("g2", F.sha2("case_id", 256), 12).alias("short"), identity.run_name("p", F.sha2("case_id", 256)).alias("long"), C.tokens_per_second(F.col("k"), F.col("k") % 4).alias("rate"), C.safe_name(odd).alias("safe"),
        validation.fits_context(F.col("k") * 100, F.lit(48)).alias("fits"), episode_runs.canonical_call(call).alias("call"), validation.equal("k", F.col("k"), F.col("k")).alias("equal"),
    )


def receipts_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).where("pos % 3 = 0")
    receipts = cases(spark, sf_dir).select("case_id", F.struct("case_id", "run_id").alias("attempt"))
    return journal.rebuilt(c.select("case_id", "pos"), receipts).select("pos", "case_id", "attempt.run_id")


def position_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n(spark, sf_dir)
    here = n.select(F.col("n").alias("pos"), "case_id").where("pos % 31 <> 0")
    there = n.select(F.col("n").alias("pos"), _unless(10, F.col("case_id"), "x").alias("case_id")).where("pos % 37 <> 0")
    return journal.positions_differ(here, there).select("pos", F.col("case").alias("here"), F.col("identity").alias("there"))


def one_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return readers.one_checksum(sums, "7")


def metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and metrics against what is expected of them."""
    made = score(with_gold(A.attempts(outputs(cases(spark, sf_dir)), F.col("run_id")), cases(spark, sf_dir).select("case_id", "expected_decision", "expected_answerability", "expected_tool")))
    wanted = spark.createDataFrame([("action_correct", "missing_instances", 0.0), ("action_correct", "total_rows", -1.0), ("schema_valid", "estimate", 2.0), ("nothing", "total_rows", 1.0)], "metric_id string, name string, value double")
    return identity.expected_faults(reports.metric_report(made), "metric_id", wanted)


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run has already, and the rest from the model; then a replay of everything, which may not ask the model."""
    c = cases(spark, sf_dir).select("case_id", "family_id", "pos", "run_id", "k", "event_type", "expected_decision", "expected_answerability", "expected_tool")
    old = A.attempts(outputs(c.where("pos % 2 = 0")), F.lit("r")).select("case_id", "family_id", "run_id", "attempt_id", "status")
    whole = A.run_or_resume(c, old, lambda todo: outputs(todo).withColumn("failure", F.lit("error")), F.lit("r"))
    again = A.run_or_resume(c, whole, A.forbidden, F.lit("r"))
    return again.select("case_id", "attempt_id", "status")


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model as a Python function: texts, typed errors, and what isn't a text."""

    def model(case: dict) -> str:
        n = int(case["case_id"]) % 6
        if n < 4:
            raise (models.ModelTimeout, models.ContextOverflow, models.BudgetExhausted, models.ModelError)[n]
        return 5 if n == 4 else '{"decision":"REFUSE","answerability":"NOT_APPLICABLE","reason":"r"}'

    made = A.attempts(models.calling(model)(cases(spark, sf_dir).select("case_id", "family_id")), F.lit("r"))
    return made.select("case_id", "status", "runtime_error_code", F.col("parsed_response.decision").alias("decision"))


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four tools with permissions and faults, each call in one of 40 cases with records and statuses of its own."""
    every = F.array(*map(F.lit, TOOLS))
    calls = cases(spark, sf_dir).select(
        F.col("case_id").alias("call_id"), (F.col("pos") % 40).cast("string").alias("case_id"), pick(TOOLS, F.col("k") % 4).alias("tool"), every.alias("available"), F.when(F.col("k") % 9 == 0, F.array(F.lit("get_record"))).otherwise(every).alias("permitted"), F.lit("nat").alias("query"),
        F.when(F.col("k") % 8 == 4, F.lit("2024-01-20").cast("date")).alias("as_of_date"), F.when(F.col("k") % 16 == 4, F.lit(2)).alias("limit"), F.concat(F.lit("r"), (F.col("k") % 8).cast("string")).alias("record_id"), F.concat(F.lit("s"), (F.col("k") % 6).cast("string")).alias("subject_id"),
        pick(("add", "subtract", "multiply", "divide"), F.col("pos") % 4).alias("operation"), F.col("k").cast("double").alias("left"), (F.col("pos") % 3).cast("double").alias("right"),
    )
    n = spark.range(400).select((F.col("id") % 40).cast("string").alias("case_id"), F.col("id").cast("int").alias("pos"), F.floor(F.col("id") / 40).alias("j"))
    records = n.select("case_id", "pos", F.concat(F.lit("r"), (F.col("j") % 6).cast("string")).alias("record_id"), F.concat(F.lit("Nation "), F.col("j").cast("string")).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("j") * 3).cast("int")).alias("observed_at"), (F.col("j") % 2 == 0).alias("authoritative"))
    statuses = n.where("j < 5").select("case_id", "pos", F.concat(F.lit("s"), (F.col("j") % 4).cast("string")).alias("subject_id"), F.concat(F.lit("st"), F.col("j").cast("string")).alias("status"), F.lit("2024-02-03").cast("date").alias("observed_at"))
    faults = spark.createDataFrame([("7", 1, "get_record", "STALE_DATA"), ("7", 0, "get_record", "TIMEOUT")], FAULT)
    return tools.simulate(calls, records, statuses, faults).select("call_id", "tool", "success", "error_code", "payload", "payload_hash")


def episode_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode for each conversation, run whole: the model says in turn what a rule of conversation and turn gives."""
    texts = {"answer": '{"decision":"RESPOND","answerability":"SUPPORTED","answer":"a"}', "call": '{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","tool_call":{"tool":"calculate","arguments":{"operation":"add","left":1,"right":2}}}', "invalid": "{"}
    start = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("case_id")).distinct().select("case_id", *[F.array(F.lit("calculate")).alias(c) for c in ("available", "permitted")])
    turn = count(1)

    def model(asked: DataFrame) -> DataFrame:
        t = next(turn)
        kind = pick(("answer", "call", "invalid", "call", "invalid", "call", "answer"), (F.col("case_id").cast("long") * 3 + t * 5) % 7)
        return asked.select("case_id", F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[kind].alias("raw_output"))

    empty = lambda schema: spark.createDataFrame([], schema)
    done, _, results = episode_runs.run_episodes(start, model, empty("case_id string, pos int, record_id string, text string, observed_at date, authoritative boolean"), empty("case_id string, pos int, subject_id string, status string, observed_at date"), empty(FAULT))
    made = results.groupBy("case_id").agg(F.count("*").alias("n_results"), F.count_if("success").alias("n_good"))
    return done.join(made, "case_id", "left").select(
        "case_id", "terminal_status", "error_code", F.col("turns").cast("long").alias("turns_used"), F.col("calls").cast("long").alias("calls_used"), F.col("repairs").cast("long").alias("repairs_used"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_good", F.lit(0)).alias("n_good")
    )


_PINS = {"repository": "repo", "revision": "rev", "prompt_version": "p1", "attention_mode": "sdpa"}
_GATES = {
    "parent protocol hash": 2, "parent protocol id": 3, "decision": 5, "pass flag": 7, "outcome": 11, "runtime profile": 13, "protocol repository": 17, "protocol revision": 19, "decision repository": 23, "decision revision": 29, "prompt version": 31,
    "protocol attention mode": 37, "decision attention mode": 41, "generation": 43, "runtime device": 47, "runtime dtype": 53, "runtime version": 59, "environment lock": 61, "case count": 67,
}


def input_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda gate, right, wrong="other": _unless(_GATES[gate], right, wrong)
    generation = F.struct(F.lit(48).alias("max_new_tokens"), F.lit(1.0).alias("temperature"))
    model = F.struct(bad("protocol repository", "repo").alias("repository"), bad("protocol revision", "rev").alias("revision"), bad("protocol attention mode", "sdpa").alias("attention_mode"))
    four = F.array(*[F.lit(x) for x in "abcd"])
    protocol = F.struct(F.lit("proto").alias("protocol_id"), model.alias("model"), F.struct(bad("prompt version", "p1").alias("version")).alias("prompt"), generation.alias("generation"), F.when(F.col("n") % 67 == 0, F.array(F.lit("a"))).otherwise(four).alias("case_ids"))
    runtime = F.struct(bad("decision attention mode", "sdpa").alias("attention_mode"), F.lit("cuda:0").alias("device"), F.lit("bf16").alias("checkpoint_parameter_dtype"), F.lit("2.1").alias("torch_version"))
    decision = F.struct(bad("decision", "PASS", "FAIL").alias("decision"), (F.col("n") % 7 != 0).alias("kq0_pass"), bad("outcome", identity.QUALIFIED).alias("outcome"), bad("runtime profile", "prof").alias("runtime_profile_id"), F.struct(bad("decision repository", "repo").alias("repository"), bad("decision revision", "rev").alias("revision")).alias("model_identity"), runtime.alias("runtime"))
    override = F.struct(bad("runtime device", "cuda:0", F.lit(None).cast("string")).alias("device"), bad("runtime dtype", "bf16").alias("checkpoint_parameter_dtype"), bad("runtime version", "2.1").alias("torch_version"))
    frozen = F.struct(F.struct(F.lit(1).alias("temperature"), _unless(43, F.lit(48), F.lit(49)).alias("max_new_tokens")).alias("generation"))  # 1 is 1.0
    profile = F.struct(bad("parent protocol hash", "h1").alias("parent_protocol_sha256"), bad("parent protocol id", "proto").alias("parent_protocol_id"), F.lit("prof").alias("profile_id"), override.alias("runtime_override"), frozen.alias("frozen_contract_preserved"), F.struct(bad("environment lock", "h2").alias("environment_lock_sha256")).alias("provenance"))
    rows = _n(spark, sf_dir).select("case_id", *[F.to_json(d).alias(name) for name, d in (("protocol", protocol), ("profile", profile), ("decision", decision))], F.lit("h1").alias("protocol_sha256"), F.lit("h2").alias("lock_sha256"))
    return validation.violations(rows, "case_id", identity.input_rules(_PINS))


def _field(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in schema.removeprefix("struct<").removesuffix(">").split(",")]


def run_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each family: its cases in order, under a generation and a runtime that hold their own names."""
    c = cases(spark, sf_dir).groupBy("family_id").agg(F.array_sort(F.collect_list(F.struct("case_id", F.sha2("case_id", 256).alias("case_sha256"), "family_id", F.md5("case_id").alias("prompt_sha256")))).alias("cases"))
    generation = F.struct(F.lit(48).alias("max_new_tokens"), F.lit(7).alias("seed"), F.lit(1.0).alias("temperature"), F.lit(0.95).alias("top_p"), F.lit(600.0).alias("wall_clock_timeout_seconds"))
    runtime = F.struct(*[(F.lit(name) if kind == "string" else F.lit(True)).alias(name) for name, kind in _field(identity.RUNTIME)])
    made = identity.run_identity(F.col("cases"), F.lit("c0"), generation, F.lit("p1"), F.lit("proto"), F.lit("h1"), runtime, F.sha2("family_id", 256))
    return c.select("family_id", made["identity_sha256"].alias("identity_sha256"), made["run_id"].alias("run_id"))


_RUNTIME_JSON = ",".join(f'"{name}":' + (f'"{name}"' if kind == "string" else "true") for name, kind in _field(identity.RUNTIME))


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(spark, sf_dir).where("n % 19 <> 0").select("case_id", F.lit("f").alias("family_id"), F.lit("c").alias("case_sha256"), F.lit("p").alias("prompt_sha256"))


def _manifest() -> dict[str, Column]:
    return {k: F.lit(k) for k in ("run_id", "identity_sha256", "implementation_commit", "protocol_sha256", "device", "parameter_dtype", "attention_mode")}


def intent_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _n(spark, sf_dir).select("case_id", _unless(2, "run_id", "x").alias("run_id"), _unless(3, "identity_sha256", F.lit(None).cast("string")).alias("identity_sha256"), _unless(5, "implementation_commit", "x").alias("implementation_commit"), _unless(7, "protocol_sha256", "x").alias("protocol_sha256"), _unless(11, "f", "x").alias("family_id"), _unless(13, "c", "x").alias("case_sha256"))
    return identity.intent_faults(rows, _manifest(), _identities(spark, sf_dir))


def receipt_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.struct(F.coalesce(_if(3, "x"), _if(2, "p")).alias("prompt_sha256"), _unless(5, "device", "x").alias("runtime_device"), _unless(7, F.lit(None).cast("string"), "x").alias("parameter_dtype"), _unless(11, "attention_mode", "x").alias("attention_mode"))
    rows = _n(spark, sf_dir).select(F.lit("run_id").alias("run_id"), _unless(13, "implementation_commit", "x").alias("implementation_commit"), F.lit("protocol_sha256").alias("protocol_sha256"), F.lit("c").alias("case_sha256"), F.struct("case_id", _unless(17, "f", "x").alias("family_id")).alias("attempt"), seen.alias("observation"))
    return identity.receipt_faults(rows, _manifest(), _identities(spark, sf_dir))


def live_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = {"python_version": _unless(2, "3.11", "3.12"), "torch_version": _unless(3, "2.1", F.lit(None).cast("string")), "cuda_visible_devices": _unless(5, "0", "0,1"), "cuda_available": F.col("n") % 7 != 0, "device_count": _unless(11, F.lit(1), F.lit(2)), "accelerator": _unless(13, "Tesla T4 x", "CPU")}
    wanted = {"python_version": F.lit("3.11"), "torch_version": F.lit("2.1"), "cuda_visible_devices": F.lit("0"), "accelerator": F.lit("Tesla T4")}
    return validation.violations(_n(spark, sf_dir), "case_id", identity.live_rules(live, wanted))


def gate_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"primary_model": 2, "base_comparator": 3, "upstream_gguf": 5}
    text = F.to_json(F.struct(*[F.struct(_unless(k, part, "x").alias("revision")).alias(part) for part, k in parts.items()]))
    return validation.violations(_n(spark, sf_dir).select("case_id", text.alias("identity")), "case_id", identity.revision_rules({p: p for p in parts}))


def gate_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of this gate are documents: records of what they hashed to, against what they hash to now."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 4 != 2).alias("verified"))
    records = d.where("n % 11 <> 5").select(F.col("path").alias("file"), _unless(7, F.col("sha256"), "changed").alias("local_sha256"), F.when(F.col("verified") | (F.col("n") % 3 == 0), F.col("sha256")).alias("upstream_sha256"), (F.col("n") % 5 != 0).alias("matches_upstream"))
    return identity.integrity_faults(records, d.where("n % 13 <> 6").select("path", "sha256"), d.select("path", "verified"))


_LOADED = {
    "identity status": 2, "weights state": 3, "primary_model.weights_verified": 5, "claims.baseline_reproduced": 7, "strict_load": 11, "missing_keys": 13, "shape_mismatches": 17, "eos_id": 19, "input_ids": 23, "generated_ids": 29, "revision": 31,
    "weights of inference": 37, "weights of state": 41, "qualified_device": 43,
}


def gate_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda rule, right, wrong: _unless(_LOADED[rule], right, wrong)
    claims = F.struct(*[F.lit(True).alias(c) for c in ("tokenizer_verified", "prompt_format_verified", "inference_verified")], bad("claims.baseline_reproduced", False, True).alias("baseline_reproduced"), F.lit(False).alias("improvement_claimed"))
    primary = F.struct(F.lit(True).alias("weights_downloaded"), bad("primary_model.weights_verified", True, False).alias("weights_verified"), F.lit("rev").alias("revision"))
    ints = lambda *x: F.array(*map(F.lit, x))
    empty = F.array().cast("array<string>")
    V = identity.VERIFIED
    docs = {
        "identity": F.struct(bad("identity status", V["identity"], "x").alias("status"), primary.alias("primary_model"), claims.alias("claims")),
        "weights": F.struct(bad("weights state", V["weights"], "x").alias("state"), F.lit(True).alias("checksum_match"), F.lit("w").alias("actual_sha256")),
        "state": F.struct(F.lit(V["state"]).alias("state"), bad("strict_load", True, False).alias("strict_load"), bad("missing_keys", empty, F.array(F.lit("k"))).alias("missing_keys"), empty.alias("unexpected_keys"), bad("shape_mismatches", F.create_map().cast("map<string,string>"), F.create_map(F.lit("k"), F.lit("v"))).alias("shape_mismatches"), bad("weights of state", "w", "x").alias("weight_sha256")),
        "inference": F.struct(F.lit(V["inference"]).alias("state"), bad("qualified_device", "cpu", "gpu").alias("qualified_device"), F.lit("sdpa").alias("attention_mode"), bad("eos_id", F.lit(2), F.lit(9)).alias("eos_id"), F.lit(3).alias("user_marker_id"), F.lit(4).alias("assistant_marker_id"), bad("input_ids", ints(2, 3), ints(3)).alias("input_ids"), bad("generated_ids", ints(1), F.array().cast("array<int>")).alias("generated_ids"), bad("revision", "rev", "x").alias("revision"), bad("weights of inference", "w", "x").alias("weight_sha256")),
    }
    return validation.violations(_n(spark, sf_dir).select("case_id", *[F.to_json(d).alias(name) for name, d in docs.items()]), "case_id", identity.load_rules())


def gate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is the record of a case of its own; every seventh is not to be found."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("case_id"), F.lit(0).alias("pos"), F.lit("gate").alias("record_id"), "text", F.lit(None).cast("date").alias("observed_at"), F.lit(True).alias("authoritative"))
    return identity.round_trip_faults(d.select("case_id"), d.where("n % 7 <> 0").drop("n"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gradewell-files-{uuid.uuid4().hex}"


def _gone(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """found, whose files stay until the driver ends."""
    until_exit(spark, folder)
    return found


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their regions as JSON lines, in order, and back."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.when(F.col("r_regionkey") != 1, F.col("r_name")).alias("region"))
    sinks.write_jsonl(rows, f"{folder}/nations.jsonl", ["key"])
    return _gone(spark, folder, readers.read_jsonl(spark, f"{folder}/nations.jsonl", "name string, key int, region string"))


def case_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as one JSON array, read by the strict reader."""
    folder = _folder(spark)
    right = _full_cases(spark, sf_dir).where(" AND ".join(f"n % {k} <> 0" for k in sorted(set(_CASE_FAULTS.values())))).select("n", "json")
    ends = right.agg(F.min("n").alias("first"), F.max("n").alias("last"))  # one row
    lines = right.join(F.broadcast(ends), F.lit(True)).select("n", F.concat(F.when(F.col("n") == F.col("first"), "[").otherwise(""), "json", F.when(F.col("n") == F.col("last"), "]").otherwise(",")).alias("line"))
    sinks.write_lines(lines, f"{folder}/cases.json", ["n"])
    return _gone(spark, folder, readers.read_cases(spark, f"{folder}/cases.json").select(F.col("pos").cast("long").alias("pos"), "case_id", F.col("gold.expected_decision").alias("expected_decision")))


def journal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    wrote = cases(spark, sf_dir).select("case_id", "family_id", F.sha2("case_id", 256).alias("case_sha256"), F.lit("1.0").alias("schema_version"))
    for k in range(2):
        sinks.write_jsonl(wrote.where(F.col("case_id").cast("long") % 2 == k), f"{folder}/part{k}.json", ["case_id"])
    return _gone(spark, folder, readers.read_intents(spark, folder).select("case_id", "family_id", "case_sha256", "run_id", "schema_version"))


def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven files of a run over all cases; what is listed, with lines; and what the gate finds: nothing."""
    folder = _folder(spark)
    c = cases(spark, sf_dir)
    made = written(A.attempts(outputs(c), F.lit("r")))  # several files are made of them
    scored = score(written(with_gold(made, c.select("case_id", "expected_decision", "expected_answerability", "expected_tool"))))  # what is joined isn't shuffled again with each file
    one = spark.range(1).select(F.lit("x").alias("name"))
    text = c.select("case_id", "family_id", C.canonical(F.struct("case_id", "family_id")).alias("json"))
    plain = made.select("pos", "case_id", "status", "attempt_id")
    sinks.write_run_bundle(
        spark, f"{folder}/run", config=one, environment=one, manifest=one, inputs=sinks.inputs_manifest(text), outputs=plain, scores=score_records(scored, F.lit("d"), F.lit("m"), "s", F.lit("harness_only")), metrics=reports.metric_report(scored),
        events=reports.event_rows(made, c, "model", "frozen").drop("run_id", "time_source"), failures=reports.failure_rows(made, scored), timing=sinks.timing_reference(made),
    )
    lines = readers.line_counts(spark, f"{folder}/run")
    faults = gates.bundle_faults(spark, f"{folder}/run").select(F.concat_ws(" ", "rule", "key").alias("path"), F.lit(-1).cast("long").alias("n_lines"))
    manifest = array_items(spark, f"{folder}/run/inputs_manifest.json").select(F.from_json("json", "sha256 string", {"mode": "FAILFAST"})["sha256"].alias("path"), F.lit(0).cast("long").alias("n_lines"))
    return _gone(spark, folder, lines.union(faults).union(manifest))


def pilot_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight files of a journaled run over all cases: how many lines each has, whether those in a list are in order, how many cases the
    manifest says, read as one object, and that a second run into the folder is refused."""
    folder, c = _folder(spark), cases(spark, sf_dir)
    gold = c.select("case_id", "expected_decision", "expected_answerability", "expected_tool")
    made = written(A.attempts(outputs(c), F.col("run_id")))  # several files are made of them
    rows = written(with_gold(made, gold))  # what is joined isn't shuffled again with each file
    scored, failed = score(rows), reports.failed(labelled(rows), True)
    parts = {
        "manifest": c.agg(F.count("*").alias("n_cases")), "receipts": made.select("case_id", "status", "attempt_id"), "scores": score_records(scored, F.lit("d"), F.lit("m"), "s", F.lit("harness_only")), "metrics": reports.metric_report(scored),
        "failures": failed, "timing": sinks.timing_reference(made), "report": reports.report_lines(reports.metric_report(scored), failed),
    }
    sinks.write_pilot_bundle(spark, f"{folder}/pilot", **parts)
    refused = 0
    try:
        sinks.write_pilot_bundle(spark, f"{folder}/pilot", **parts)
    except FileExistsError:
        refused = 1
    none = F.lit(None).cast("boolean")
    lines = readers.line_counts(spark, f"{folder}/pilot").select("path", F.col("n_lines").alias("n"), none.alias("in_order"))
    metric = spark.read.text(f"{folder}/pilot/metrics.json").select(F.transform(F.from_json("value", "array<struct<metric_id:string>>"), lambda m: m["metric_id"]).alias("names"))
    listed = spark.read.text(f"{folder}/pilot/checksums.sha256", wholetext=True).select(F.transform(F.split(F.rtrim("value", F.lit("\n")), "\n"), lambda x: F.substring_index(x, "  ", -1)).alias("names"))
    ordered = lambda df, name: df.select(F.lit(name), F.size("names").cast("long"), F.col("names") == F.array_sort("names"))
    said = readers.read_object(spark, f"{folder}/pilot/run_manifest.json", "n_cases long").select(F.lit("cases of the manifest"), "n_cases", none)
    again = c.limit(1).select(F.lit("refused"), F.lit(refused).cast("long"), none)
    return _gone(spark, folder, lines.union(ordered(metric, "metrics")).union(ordered(listed, "checksums")).union(said).union(again))


def _streamed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """rows, written, and read as a stream."""
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


def _finished(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream appends until its input ends."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs arrive as a stream; their scores, reported."""
    folder, c = _folder(spark), cases(spark, sf_dir)
    stream = runs.scored_stream(_streamed(spark, outputs(c), folder), c.select("case_id", "expected_decision", "expected_answerability", "expected_tool"), F.col("run_id"))
    return _gone(spark, folder, reports.metric_report(_finished(stream.select("case_id", "metric_id", "eligible", "value"), folder)))


def stream_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    kind = pick(("answer", "call", "invalid", "call", "invalid", "call", "answer"), (F.col("conv_id") * 3 + F.col("turn") * 5) % 7)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("case_id"), F.col("turn").cast("int").alias("turn_index"), kind.alias("kind"))
    return _gone(spark, folder, _finished(runs.episode_stream(_streamed(spark, turns, folder)), folder))


def stream_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case at most once, though they arrive twice, under two checkpoints."""
    folder = _folder(spark)
    n = _n(spark, sf_dir).select("case_id")
    arriving = _streamed(spark, n.union(n), folder)
    for k in range(2):
        runs.journaled(arriving, f"{folder}/intents", f"{folder}/receipts", lambda df: df.withColumn("raw_output", F.lit("x")), f"{folder}/state{k}").awaitTermination()
    found = [spark.read.parquet(f"{folder}/{part}").groupBy("case_id").agg(F.count("*").alias(part)) for part in ("intents", "receipts")]
    return _gone(spark, folder, found[0].join(found[1], "case_id", "full_outer"))


_NUMBERS = "n AS (SELECT event_id AS n, event_id::VARCHAR AS case_id FROM events)"
_BAD = lambda rules: _every({rule: f"n % {k} = 0" for rule, k in rules.items()}, "case_id", "n")
_TOOL_SQL = f"""{_BASE}, q AS (SELECT case_id AS call_id, pos, k, (pos % 40)::VARCHAR AS c40, CASE k % 4 WHEN 0 THEN 'search_records' WHEN 1 THEN 'get_record' WHEN 2 THEN 'calculate' ELSE 'lookup_status' END AS tool FROM e),
g AS (SELECT *, CASE WHEN k % 9 = 0 AND tool <> 'get_record' THEN 'PERMISSION_DENIED' WHEN tool = 'get_record' AND c40 = '7' THEN 'TIMEOUT' END AS gate FROM q),
r AS (SELECT (i % 40)::VARCHAR AS c40, i AS pos, i // 40 AS j, '{{"authoritative":' || CASE WHEN (i // 40) % 2 = 0 THEN 'true' ELSE 'false' END || ',"observed_at":"' || strftime(DATE '2024-01-01' + (i // 40 * 3)::INT, '%Y-%m-%d') || '","record_id":"r' || ((i // 40) % 6)::VARCHAR || '","text":"Nation ' || (i // 40)::VARCHAR || '"}}' AS json FROM range(400) t(i)),
h AS (SELECT call_id, json, CASE WHEN k % 16 = 4 THEN 2 ELSE 5 END AS n, row_number() OVER (PARTITION BY call_id ORDER BY j DESC) AS rank FROM g JOIN r ON g.c40 = r.c40 WHERE tool = 'search_records' AND (k % 8 <> 4 OR j * 3 <= 19)),
ll AS (SELECT call_id, string_agg(json, ',' ORDER BY rank) AS list FROM h WHERE rank <= n GROUP BY call_id),
v AS (SELECT g.*, CASE pos % 4 WHEN 0 THEN k + pos % 3 WHEN 1 THEN k - pos % 3 WHEN 2 THEN k * (pos % 3) ELSE CASE WHEN pos % 3 <> 0 THEN k / (pos % 3)::DOUBLE END END::DOUBLE AS value FROM g),
b AS (SELECT v.*, CASE tool WHEN 'search_records' THEN '{{"kind":"search_records","records":[' || coalesce(list, '') || ']}}' WHEN 'get_record' THEN CASE WHEN k % 8 < 6 THEN '{{"kind":"get_record","record":' || json || '}}' END
  WHEN 'calculate' THEN '{{"kind":"calculate","result":' || value::VARCHAR || '}}' ELSE CASE WHEN k % 6 < 4 THEN '{{"kind":"lookup_status","status":{{"observed_at":"2024-02-03","status":"st' || (k % 6)::VARCHAR || '","subject_id":"s' || (k % 6)::VARCHAR || '"}}}}' END END AS body
  FROM v LEFT JOIN ll ON v.call_id = ll.call_id LEFT JOIN r ON v.c40 = r.c40 AND r.j = v.k % 8 AND v.k % 8 < 6),
o AS (SELECT *, coalesce(gate, CASE WHEN body IS NULL THEN CASE tool WHEN 'calculate' THEN 'ARGUMENT_INVALID' ELSE 'NOT_FOUND' END END) AS error_code FROM b)
SELECT call_id, tool, error_code IS NULL AS success, error_code, CASE WHEN error_code IS NULL THEN body END AS payload, CASE WHEN error_code IS NULL THEN sha256(body) END AS payload_hash FROM o"""
_RIGHT = "CASE status WHEN 0 THEN raw AND parsed AND NOT failed AND NOT code WHEN 1 THEN raw AND NOT parsed AND failed AND NOT code WHEN 2 THEN NOT raw AND NOT parsed AND NOT failed AND code AND n % 14 = 0 ELSE NOT raw AND NOT parsed AND NOT failed AND code AND n % 14 <> 0 END"

CHECK_SQL = {
    "attempt_violations": f"WITH {_NUMBERS}, f AS (SELECT *, n % 4 AS status, n % 2 = 0 AS raw, n % 3 = 0 AS parsed, n % 5 = 0 AS failed, n % 7 = 0 AS code FROM n) " + _every({"V10": "raw <> (parsed <> failed)", "V11": f"NOT ({_RIGHT})"}, "case_id", "f"),
    "score_violations": f"WITH {_NUMBERS}, f AS (SELECT *, n % 11 <> 0 AND n % 13 <> 0 AND n % 3 = 0 AS empty FROM n) " + _every({"V13": "empty <> (n % 2 = 0)", "finite": "n % 11 = 0 OR n % 13 = 0"}, "case_id", "f"),
    "observation_violations": f"WITH {_NUMBERS}, f AS (SELECT *, CASE WHEN n % 2 = 0 THEN 0 WHEN n % 11 = 0 THEN 1 END AS code FROM n) " + _every({"V14": "n % 5 = 0 OR n % 7 = 0", "V15": "n % 3 = 0 AND (code IS NULL OR code <> 0 OR n % 13 = 0 OR (n % 4 % 2 = 1 AND (n % 17 = 0 OR n % 4 = 2)))", "V16": "n % 3 = 1 AND code IS NOT NULL"}, "case_id", "f"),
    "result_violations": f"WITH {_NUMBERS} " + _every({"V17": "NOT CASE WHEN n % 2 = 0 THEN n % 5 < 3 AND n % 7 < 5 AND n % 3 <> 0 ELSE n % 3 = 0 AND n % 5 >= 3 END"}, "case_id", "n"),
    "episode_violations": f"WITH {_NUMBERS} " + _every({"V18": "NOT CASE n % 4 WHEN 0 THEN n % 3 = 0 AND n % 5 <> 0 AND n % 2 <> 0 WHEN 1 THEN n % 3 <> 0 AND n % 5 = 0 ELSE n % 3 <> 0 AND n % 2 = 0 END"}, "case_id", "n"),
    "receipt_violations": f"WITH {_NUMBERS} " + _every({"V19": "n % 3 = 0 OR n % 5 = 0 OR n % 7 = 0"}, "case_id", "n"),
    "bound_violations": f"WITH {_NUMBERS} " + _every({"V22": "n % 3 = 0 OR n % 5 = 0", "V23": "n % 7 = 0 OR n % 4 = 0 OR n % 6 = 0 OR n % 6 = 5"}, "case_id", "n"),
    "case_contract": f"WITH {_NUMBERS} " + _BAD(_CASE_FAULTS),
    "contract_schemas": f"""WITH {_NUMBERS}, f(contract, field, declared, required, rule) AS (VALUES
      ('eval_case', 'gold', true, true, 0), ('eval_case', 'input', true, true, 0), ('eval_case', 'license', true, true, 29), ('eval_case', 'provenance', true, true, 0), ('eval_case', 'review_status', true, true, 0), ('eval_case', 'schema_version', true, false, -1),
      ('eval_case', 'source', true, true, 0), ('eval_case', 'split', true, false, 0), ('eval_input', 'available_tools', true, false, 0), ('eval_input', 'case_id', true, true, 0), ('eval_input', 'evaluation_time_utc', true, true, 13), ('eval_input', 'evidence', true, false, -1),
      ('eval_input', 'family_id', true, true, 0), ('eval_input', 'languages', true, true, 0), ('eval_input', 'messages', true, true, 0), ('eval_input', 'permitted_tools', true, false, 0), ('eval_input', 'schema_version', true, false, -1), ('eval_input', 'more', false, false, -17),
      ('eval_gold', 'case_id', true, true, 0), ('eval_gold', 'expected_answerability', true, true, 0), ('eval_gold', 'expected_claims', true, false, -1), ('eval_gold', 'expected_decision', true, true, 0), ('eval_gold', 'expected_tool_call', true, false, 0),
      ('eval_gold', 'permitted_tools', true, false, 0), ('eval_gold', 'rubric', true, true, 0), ('eval_gold', 'schema_version', true, false, -1))
      SELECT contract, field, declared, required, (SELECT count(*) FROM n WHERE CASE rule WHEN 0 THEN true WHEN -1 THEN false WHEN 29 THEN n % 29 <> 0 WHEN 13 THEN n % 13 <> 0 ELSE n % 17 = 0 END) AS n_cases FROM f""",
    "run_balance": _BASE + "SELECT run_id, count(*) + CASE WHEN run_id = 'run-2' THEN 1 ELSE 0 END AS attempted_cases, run_id = 'run-0' AS balanced FROM a GROUP BY run_id",
    "summary_balanced": _BASE + "SELECT run_id, (SELECT count(*) FROM a WHERE run_id = 'run-0') AS expected_cases, count(*) = (SELECT count(*) FROM a WHERE run_id = 'run-0') AS balanced FROM a GROUP BY run_id",
    "case_orders": _BASE + "SELECT family_id, string_agg(case_id, ',' ORDER BY pos DESC) AS case_ids FROM e GROUP BY family_id",
    "tensor_totals": "SELECT sum(p_size::BIGINT * 64)::BIGINT AS parameters, 'bf16,f32' AS dtypes, 'cpu' AS devices FROM part",
    "nucleus": "WITH t AS (SELECT l_orderkey, l_linenumber AS token, (l_quantity::INT % 16 + 1) / 64.0::DOUBLE AS p FROM lineitem), m AS (SELECT *, sum(p) OVER (PARTITION BY l_orderkey ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) - p AS mass FROM t) SELECT l_orderkey, token, p FROM m WHERE mass <= 0.25",
    "run_names": _BASE + """SELECT case_id, 'g2-' || substr(sha256(case_id), 1, 12) AS short, 'p-' || substr(sha256(case_id), 1, 16) AS long, CASE WHEN k = 0 OR k % 4 = 0 THEN 0.0::DOUBLE ELSE k / (k % 4)::DOUBLE END AS rate, k % 5 <> 0 AND k % 7 <> 0 AS safe, k * 100 + 48 <= 4096 AS fits,
      '{"arguments":{"record_id":"' || family_id || '"},"tool":"get_record"}' AS call, true AS equal FROM e""",
    "receipts_rebuilt": _BASE + "SELECT pos, case_id, run_id FROM c WHERE pos % 3 = 0",
    "position_faults": f'WITH {_NUMBERS}, x AS (SELECT n AS pos, CASE WHEN n % 31 <> 0 THEN case_id END AS here, CASE WHEN n % 37 <> 0 THEN CASE WHEN n % 10 = 0 THEN \'x\' ELSE case_id END END AS there FROM n) SELECT * FROM x WHERE here IS DISTINCT FROM there',
    "one_checksum": "SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256 FROM documents WHERE doc_id = 7",
    "metric_lookup": "SELECT * FROM (VALUES ('total_rows', 'action_correct'), ('estimate', 'schema_valid'), ('total_rows', 'nothing')) t(rule, key)",
    "resumed_run": _BASE + "SELECT case_id, 'r:' || case_id || ':1' AS attempt_id, CASE WHEN pos % 2 = 0 THEN status ELSE 'execution_error' END AS status FROM a",
    "model_calls": f"WITH {_NUMBERS} SELECT case_id, CASE n % 6 WHEN 0 THEN 'timeout' WHEN 5 THEN 'completed' ELSE 'execution_error' END AS status, CASE n % 6 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'CONTEXT_OVERFLOW' WHEN 2 THEN 'BUDGET_EXHAUSTED' WHEN 5 THEN NULL ELSE 'EXECUTION_ERROR' END AS runtime_error_code, CASE n % 6 WHEN 5 THEN 'REFUSE' END AS decision FROM n",
    "tool_results": _TOOL_SQL,
    "episode_runs": f"""WITH x AS (SELECT * FROM ({_EPISODES.replace("FROM conversations)", "FROM (SELECT DISTINCT conv_id, turn FROM (SELECT DISTINCT conv_id FROM conversations), range(1, 5) t(turn)))")}))
      SELECT case_id::VARCHAR AS case_id, CASE terminal_status WHEN 'open' THEN 'budget_exhausted' ELSE terminal_status END AS terminal_status, CASE WHEN terminal_status <> 'completed' THEN 'BUDGET_EXHAUSTED' END AS error_code, turns_used, calls_used, repairs_used, calls_used AS n_results, calls_used AS n_good FROM x""",
    "input_gates": f"WITH {_NUMBERS} " + _BAD(_GATES),
    "run_identities": _BASE + f""", p AS (SELECT family_id, '{{"cases":[' || string_agg('{{"case_id":"' || case_id || '","case_sha256":"' || sha256(case_id) || '","family_id":"' || family_id || '","prompt_sha256":"' || md5(case_id) || '"}}', ',' ORDER BY case_id) ||
      '],"execution_commit":"c0","generation":{{"max_new_tokens":48,"seed":7,"temperature":1.0,"top_p":0.95,"wall_clock_timeout_seconds":600.0}},"prompt_version":"p1","protocol_id":"proto","protocol_sha256":"h1","runtime":{{{_RUNTIME_JSON}}},"selected_dataset_sha256":"' || sha256(family_id) || '"}}' || chr(10) AS json FROM e GROUP BY family_id)
      SELECT family_id, sha256(json) AS identity_sha256, 'proto-' || substr(sha256(json), 1, 16) AS run_id FROM p""",
    "intent_faults": f"WITH {_NUMBERS} " + _every({"run_id": "n % 2 = 0", "identity_sha256": "n % 3 = 0", "implementation_commit": "n % 5 = 0", "protocol_sha256": "n % 7 = 0", "family_id": "n % 11 = 0 OR n % 19 = 0", "case_sha256": "n % 13 = 0 OR n % 19 = 0", "case_id": "n % 19 = 0"}, "case_id", "n"),
    "receipt_faults": f"WITH {_NUMBERS} " + _every({"implementation_commit": "n % 13 = 0", "case_sha256": "n % 19 = 0", "case_id": "n % 19 = 0", "family_id": "n % 17 = 0 OR n % 19 = 0", "prompt_sha256": "n % 3 = 0 OR (n % 2 = 0 AND n % 19 = 0)", "runtime_device": "n % 5 = 0", "parameter_dtype": "n % 7 = 0", "attention_mode": "n % 11 = 0"}, "case_id", "n"),
    "live_runtime": f"WITH {_NUMBERS} " + _BAD({"python_version": 2, "torch_version": 3, "cuda_visible_devices": 5, "cuda_available": 7, "device_count": 11, "accelerator": 13}),
    "gate_revisions": f"WITH {_NUMBERS} " + _BAD({"primary_model": 2, "base_comparator": 3, "upstream_gguf": 5}),
    "gate_integrity": """WITH d AS (SELECT doc_id AS n, doc_id::VARCHAR AS key FROM documents)
      SELECT CASE WHEN n % 13 = 6 THEN 'missing' WHEN n % 11 = 5 THEN 'unexpected' ELSE 'mismatch' END AS rule, key FROM d WHERE n % 13 = 6 OR n % 11 = 5 OR n % 7 = 0
      UNION ALL SELECT 'upstream', key FROM d WHERE (n % 4 <> 2 AND (n % 5 = 0 OR n % 11 = 5)) OR (n % 4 = 2 AND n % 3 = 0 AND n % 11 <> 5)""",
    "gate_load": f"WITH {_NUMBERS} " + _BAD(_LOADED),
    "gate_round_trip": "SELECT 'round trip' AS rule, doc_id::VARCHAR AS key FROM documents WHERE doc_id % 7 = 0",
    "pilot_bundle": _BASE + """, t AS (SELECT count(*) AS n, (SELECT count(*) FROM w) AS f FROM a)
      SELECT path, each * n + fails * f + more AS n, NULL::BOOLEAN AS in_order FROM t, (VALUES ('run_manifest.json', 0, 0, 1), ('case_receipts.jsonl', 1, 0, 0), ('scores.jsonl', 4, 0, 0), ('metrics.json', 0, 0, 1), ('failures.jsonl', 0, 1, 0), ('timing.csv', 1, 0, 1), ('BASELINE_REPORT.md', 0, 1, 8), ('checksums.sha256', 0, 0, 7), ('cases of the manifest', 1, 0, 0), ('refused', 0, 0, 1)) x(path, each, fails, more)
      UNION ALL SELECT 'metrics', 4, true UNION ALL SELECT 'checksums', 7, true""",
    "stream_scores": _BASE + _METRICS,
    "stream_episodes": f"SELECT case_id::VARCHAR AS case_id, terminal_status, turn_index, turns_used, calls_used, repairs_used FROM ({_EPISODES}) WHERE terminal_status <> 'open'",
    "stream_journal": f"WITH {_NUMBERS} SELECT case_id, 1 AS intents, 1 AS receipts FROM n",
    "jsonl_round_trip": "SELECT n_name AS name, n_nationkey AS key, CASE WHEN r_regionkey <> 1 THEN r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "case_file": f"WITH {_NUMBERS} SELECT row_number() OVER (ORDER BY n) - 1 AS pos, case_id, 'CALL_TOOL' AS expected_decision FROM n WHERE " + " AND ".join(f"n % {k} <> 0" for k in sorted(set(_CASE_FAULTS.values()))),
    "journal_files": _BASE + "SELECT case_id, family_id, sha256(case_id) AS case_sha256, NULL::VARCHAR AS run_id, '1.0' AS schema_version FROM e",
    "bundle_round_trip": _BASE + """, t AS (SELECT count(*) AS n FROM a), u AS (SELECT * FROM (VALUES ('resolved_config.json', 0, 1), ('environment.json', 0, 1), ('manifest.json', 0, 1), ('inputs_manifest.json', 0, 1), ('metrics.json', 0, 1), ('outputs.jsonl', 1, 0), ('scores.jsonl', 4, 0), ('events.jsonl', 1, 0), ('timing.csv', 1, 1), ('checksums.sha256', 0, 10)) x(path, each, more))
      SELECT path, n * each + more AS n_lines FROM u, t UNION ALL SELECT 'failures.jsonl', count(*) FROM w JOIN a USING (case_id) UNION ALL SELECT sha256('{"case_id":"' || case_id || '","family_id":"' || family_id || '"}' || chr(10)), 0 FROM e""",
}
CHECKS = {
    f.__name__: f
    for f in (
        attempt_violations, score_violations, observation_violations, result_violations, episode_violations, receipt_violations, bound_violations, case_contract, contract_schemas, run_balance, summary_balanced, case_orders, tensor_totals, nucleus, run_names,
        receipts_rebuilt, position_faults, one_checksum, metric_lookup, resumed_run, model_calls, tool_results, input_gates, run_identities, intent_faults, receipt_faults, live_runtime, gate_revisions, gate_integrity, gate_load, gate_round_trip,
        jsonl_round_trip, case_file, journal_files, bundle_round_trip, pilot_bundle, stream_scores, stream_episodes, stream_journal,
    )
} | {"episode_runs": episode_runs_query}
