"""A query for each operator: name -> function of (spark, sf_dir). All work on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions import canonical as C
from gradewell.functions.prompt import prompt
from gradewell.functions.response import with_response
from gradewell.operators import episodes, journal, reports, tools, validation
from gradewell.operators.attempts import attempts, resume_faults, resume_plan, select_cases
from gradewell.operators.scoring import labelled, score, with_gold
from gradewell.plans.derived import TEXTS, cases, conversation_cases, outputs, pick, records, searches, table
from gradewell.plans.checks import CHECK_SQL, CHECKS
from gradewell.plans.job_queries import JOB_SQL, JOBS
from gradewell.plans.oracles import ORACLES as _SQL
from gradewell.schemas import TOOLS


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(outputs(cases(spark, sf_dir)), F.col("run_id"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", "expected_decision", "expected_answerability", "expected_tool")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(with_gold(_attempts(spark, sf_dir), _gold(spark, sf_dir)))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(with_gold(_attempts(spark, sf_dir), _gold(spark, sf_dir)))


def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.metric_report(_scored(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = cases(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n"))
    return reports.run_summary(_attempts(spark, sf_dir), 0).drop("expected_cases", "balanced").join(expected, "run_id").withColumnRenamed("n", "expected_cases")


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("case_id", "metric_id", "eligible", "value", "missing_reason", F.array_join("failure_labels", ",").alias("failure_labels"))


def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed(_labelled(spark, sf_dir)).withColumn("failure_labels", F.array_join("failure_labels", ","))


def pilot_failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.failed(_labelled(spark, sf_dir), True).withColumn("failure_labels", F.array_join("failure_labels", ","))


def parse_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = with_response(cases(spark, sf_dir).select("case_id", pick(tuple(t for t, _ in TEXTS), F.col("pos") % len(TEXTS)).alias("raw")), F.col("raw"), "p")
    return shown.select("case_id", F.coalesce("p.failure.code", F.lit("OK")).alias("code"), F.col("p.response.decision").alias("decision"))


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return resume_plan(c.select("case_id", "pos"), c.where("pos % 3 = 0").select("case_id"))


def resume_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir).select("case_id", "family_id", "run_id", "pos")
    old = c.select("case_id", F.when(F.col("pos") % 5 == 0, "x").otherwise(F.col("family_id")).alias("family_id"), "run_id", "pos").where("pos % 4 = 0")
    old = old.union(old.where("pos % 8 = 0")).union(c.where("pos % 9 = 0").select(F.concat(F.lit("no-"), "case_id"), "family_id", "run_id", "pos"))
    return resume_faults(c, old, "run-1")


def journal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return journal.journal_states(c.where("pos % 11 <> 0"), c.where("pos % 2 = 0"), c.where("pos % 4 = 0 OR pos % 7 = 0"))


def case_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.violations(conversation_cases(spark, sf_dir), "case_id", validation.case_rules())


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


def permission_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = lambda n: F.filter(F.transform(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(1 << i).alias("b")) for i, t in enumerate(TOOLS)]), lambda x: F.when(n.bitwiseAND(x["b"]) != 0, x["t"])), lambda x: x.isNotNull())
    c = cases(spark, sf_dir).withColumns({"a": bits(F.col("k")), "p": bits((F.col("k") / 3).cast("int"))})
    return c.select("case_id", *tools.permission_flags(F.col("p")), validation.subset(F.col("p"), F.col("a")).alias("is_subset"), validation.same_set(F.col("p"), F.col("a")).alias("is_equal"), validation.unique(F.concat("a", "p")).alias("is_unique"))


def tool_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.search_matches(searches(spark, sf_dir), records(spark, sf_dir)).select("call_id", "rank", "record_id")


def tool_get_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cases(spark, sf_dir).select(F.col("case_id").alias("call_id"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("record_id"))
    held = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), (F.col("doc_id") % 50).cast("string")).alias("key"), F.col("doc_id").alias("pos"), F.length("text").cast("long").alias("n"))
    return tools.first_match(calls, held, "record_id", "key").select("call_id", F.col("hit").isNotNull().alias("success"), F.coalesce("hit.pos", F.lit(-1)).alias("pos"), F.coalesce("hit.n", F.lit(-1)).alias("n_chars"))


def tool_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cases(spark, sf_dir).select(F.col("case_id").alias("call_id"), (F.col("pos") * 3).alias("subject"))
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("pos"))
    return tools.first_match(calls, held, "subject", "o_orderkey").select("call_id", F.col("hit.o_orderstatus").alias("status"), F.when(F.col("hit").isNull(), "NOT_FOUND").alias("error_code"))


def tool_calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    done = line.select("l_orderkey", "l_linenumber", tools.calculated(pick(("add", "subtract", "multiply", "divide"), F.col("l_linenumber") % 4), F.col("l_extendedprice"), F.col("l_discount")).alias("c"))
    return done.select("l_orderkey", "l_linenumber", "c.result", "c.error_code")


def tool_fault_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = spark.createDataFrame([(0, "get_record", "TIMEOUT"), (1, "get_record", "STALE_DATA"), (2, "calculate", "MALFORMED_RESPONSE")], "pos int, tool string, error_code string")
    calls = cases(spark, sf_dir).select("case_id", pick(TOOLS, F.col("k") % 4).alias("tool"), F.when(F.col("k") % 5 == 0, F.array(F.lit("calculate"))).otherwise(F.array(*map(F.lit, TOOLS))).alias("available"), F.when(F.col("k") % 3 == 0, F.array(F.lit("get_record"))).otherwise(F.array(*map(F.lit, TOOLS))).alias("permitted"))
    return tools.with_fault(calls, faults).select("case_id", "tool", tools.gate(F.col("available"), F.col("permitted"), F.col("tool"), F.col("fault")).alias("error_code"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick(("answer", "call", "invalid", "call", "invalid", "call", "answer"), (F.col("conv_id") * 3 + F.col("turn") * 5) % 7)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("turn_index"), kind.alias("kind"))


def episode_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.terminal_states(_turns(spark, sf_dir))


def episode_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "kind"))), lambda x: x["kind"])
    s = episodes.fold(F.col("kinds"))
    return _turns(spark, sf_dir).groupBy("case_id").agg(ordered.alias("kinds")).select("case_id", s["status"].alias("terminal_status"), s["turns"].cast("long").alias("turns_used"), s["calls"].cast("long").alias("calls_used"), s["repairs"].cast("long").alias("repairs_used"))


def call_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cases(spark, sf_dir).select(F.col("family_id").alias("case_id"), "pos", (F.col("k") % 2).alias("state_version"), F.col("event_type").alias("call"))
    return episodes.tracked(calls, 6).select("case_id", "pos", "stagnant", "verdict")


def call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cases(spark, sf_dir).select(F.col("family_id").alias("case_id"), F.col("pos").alias("turn_index"))
    return episodes.call_ids(calls).select("turn_index", "call_id")


def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.event_rows(_attempts(spark, sf_dir), cases(spark, sf_dir), "scripted", "frozen")
    return rows.select("run_id", "sequence", "case_id", "status", "event_time_utc", "artifact_ref")


def _case_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", "run_id", "pos", C.canonical(F.struct("case_id", "expected_answerability", "expected_decision", "expected_tool", "family_id", "k")).alias("json"))


def case_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_json(spark, sf_dir).select("case_id", C.case_digest(F.col("json")).alias("case_sha256"), C.payload_digest(F.col("json")).alias("payload_sha256"))


def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dataset_digest(_case_json(spark, sf_dir), "pos", "json", ("run_id",))


def checksum_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.sha2("text", 256).alias("sha256"))
    return journal.digest_faults(d.where("doc_id % 50 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 20 == 1, F.lit("0")).otherwise(F.upper("sha256"))), d.where("doc_id % 33 <> 0"))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir).select("case_id", "pos", "status", "runtime_error_code")
    b = a.where("pos % 13 <> 0").withColumn("status", F.when(F.col("pos") % 6 == 0, "timeout").otherwise(F.col("status")))
    return journal.differences(a.where("pos % 17 <> 0"), b, "case_id", ["status", "runtime_error_code"])


def ordered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    ids = c.where("k = 5").select("case_id", (-F.col("pos")).alias("pos")).union(c.where("k = 7").select(F.concat(F.lit("no-"), "case_id"), -F.col("pos")))
    return select_cases(c.select("case_id", "family_id"), ids)


def shape_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("n"), F.col("p_size").alias("size"))
    side = lambda df, size: df.select("name", F.array(size, F.lit(64)).alias("shape"))
    return journal.shape_faults(side(p.where("n % 7 <> 0"), F.col("size")), side(p.where("n % 11 <> 0"), F.col("size") + F.when(F.col("n") % 13 == 0, 1).otherwise(0)))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversation_cases(spark, sf_dir).select("case_id", *[F.col(f"input.{n}").alias(n) for n in ("messages", "evidence", "available_tools", "permitted_tools")])
    text = prompt(F.col("messages"), F.when(F.col("case_id").cast("long") % 2 == 0, F.col("evidence")).otherwise(F.filter("evidence", lambda d: F.lit(False))), F.col("available_tools"), F.col("permitted_tools"))
    return c.select("case_id", F.sha2(text, 256).alias("prompt_sha256"), F.length(text).cast("long").alias("n_chars"))


def timing_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir).join(cases(spark, sf_dir).select("case_id", "value", "k"), "case_id")
    none = F.lit(None)
    return reports.timing_rows(a.withColumns({
        "transport_status": F.when(F.col("status") == "timeout", "timeout").otherwise("completed"), "elapsed_seconds": F.col("k") / 8, "model_load_seconds": F.when(F.col("status") != "timeout", F.col("k") / 4), "model_inference_seconds": F.when(F.col("status") == "completed", F.col("k") / 2),
        "input_token_count": F.col("k"), "output_token_count": none.cast("int"), "stop_reason": F.when(F.col("k") % 2 == 0, "max_new_tokens"),
    }))


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_lines(metric_report(spark, sf_dir), reports.failed(_labelled(spark, sf_dir), True))


QUERIES = {
    "metric_report": metric_report, "run_summary": run_summary, "scores_long": scores_long, "failure_rows": failure_rows, "pilot_failure_rows": pilot_failure_rows, "parse_codes": parse_codes, "resume_plan": resume, "resume_rules": resume_rules,
    "journal_states": journal_states, "case_violations": case_violations, "duplicate_keys": duplicate_keys, "permission_sets": permission_sets, "tool_search_topk": tool_search_topk, "tool_get_first": tool_get_first, "tool_status": tool_status,
    "tool_calculate": tool_calculate, "tool_fault_precedence": tool_fault_precedence, "episode_terminal": episode_terminal, "episode_fold": episode_fold, "call_tracker": call_tracker, "call_ids": call_ids, "event_sequence": event_sequence,
    "case_digests": case_digests, "dataset_digest": dataset_digest, "checksum_diff": checksum_diff, "run_comparison": run_comparison, "ordered_selection": ordered_selection, "shape_mismatch": shape_mismatch, "prompt_text": prompt_text, "timing_csv": timing_csv, "report_table": report_table,
} | CHECKS | JOBS
ORACLES = _SQL | CHECK_SQL | JOB_SQL
