"""Four metrics for each attempt, in long form, with eligibility, reasons for what is missing, and failure labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labels(*some: Column) -> Column:
    return F.filter(F.array(*some), lambda x: x.isNotNull())


def _parts() -> list[Column]:
    """The four scores of an attempt with its gold, as structs."""
    runtime = F.col("status").isin("timeout", "execution_error")
    reason = F.when(F.col("status") == "timeout", F.lit("runtime_timeout")).when(runtime, F.concat(F.lit("runtime_"), F.lower("runtime_error_code")))
    one = lambda yes: F.when(yes, F.lit(1.0)).otherwise(F.lit(0.0))
    completed = F.col("status") == "completed"
    wants, calls = F.col("expected_decision") == "CALL_TOOL", completed & (F.col("decision") == "CALL_TOOL")
    attempt = (
        F.when(F.col("status") == "invalid_response", F.array(F.lit("parser_failure"), F.lit("invalid_schema")))
        .when(F.col("status") == "timeout", F.array(F.lit("timeout")))
        .when(F.col("status") == "execution_error", F.array(F.when(F.col("runtime_error_code") == "CONTEXT_OVERFLOW", "overflow").otherwise("incomplete_run")))
        .otherwise(F.array().cast("array<string>"))
    )
    action = F.when(completed, labels(
        F.when(wants & ~calls, "missed_call"), F.when(~wants & calls, "unnecessary_call"), F.when(wants & calls & ~F.col("tool").eqNullSafe(F.col("expected_tool")), "wrong_tool"),
    )).otherwise(attempt)
    answer = F.when(completed, labels(F.when(F.col("answerability") != F.col("expected_answerability"), "wrong_answerability"))).otherwise(attempt)
    none, no_reason = F.array().cast("array<string>"), F.lit(None).cast("string")

    def row(metric: str, eligible: Column, value: Column, missing: Column, found: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric_id"), eligible.alias("eligible"), value.cast("double").alias("value"), missing.alias("missing_reason"), found.alias("failure_labels"))

    tool = wants & ~runtime
    return [
        row("action_correct", F.lit(True), one(completed & F.col("decision").eqNullSafe(F.col("expected_decision"))), no_reason, action),
        row("answerability_correct", F.lit(True), one(completed & F.col("answerability").eqNullSafe(F.col("expected_answerability"))), no_reason, answer),
        row("schema_valid", ~runtime, F.when(~runtime, one(completed)), F.when(runtime, reason), attempt),
        row("tool_identity_correct", tool, F.when(tool, one(calls & F.col("tool").eqNullSafe(F.col("expected_tool")))), F.when(~wants, F.lit("not_tool_required")).when(runtime, reason), F.when(wants, action).otherwise(none)),
    ]


def score(rows: DataFrame) -> DataFrame:
    """rows: an attempt with its gold: run_id, case_id, family_id, status, runtime_error_code, decision, answerability, tool (null unless
    completed), expected_decision, expected_answerability, expected_tool; other columns are passed on. Four rows for each, no shuffle."""
    own = [c for c in rows.columns if c not in ("metric_id", "eligible", "value", "missing_reason", "failure_labels")]
    return rows.withColumn("__s", F.explode(F.array(*_parts()))).select(*own, "__s.*")


def labelled(rows: DataFrame) -> DataFrame:
    """rows as score() takes them, with all labels of their four scores: distinct, sorted. A row stays a row, and nothing is shuffled."""
    return rows.withColumn("failure_labels", F.array_sort(F.array_distinct(F.concat(*[p["failure_labels"] for p in _parts()]))))


def with_gold(attempts: DataFrame, cases: DataFrame) -> DataFrame:
    """Attempts joined to gold (case_id, expected_decision, expected_answerability, expected_tool), as score() takes them."""
    return attempts.join(cases, "case_id").withColumns({"decision": F.col("parsed_response.decision"), "answerability": F.col("parsed_response.answerability"), "tool": F.col("parsed_response.tool_call.tool")})


def score_records(scores: DataFrame, dataset_hash: Column, model_hash: Column, scorer: str, review_status: Column) -> DataFrame:
    """Scores in the form they are written in."""
    return scores.select(
        F.col("status").alias("attempt_status"), "case_id", dataset_hash.alias("dataset_hash"), "eligible", F.array(F.concat(F.lit("attempt:"), F.col("attempt_id"))).alias("evidence_refs"), "failure_labels", "family_id",
        "metric_id", "missing_reason", model_hash.alias("model_identity_hash"), review_status.alias("review_status"), "run_id", F.lit("1.0").alias("schema_version"), F.lit(scorer).alias("scorer_version"), "value",
    )
