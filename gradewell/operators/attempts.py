"""Attempts: one row for each case of a run, from raw model outputs; resuming a run from what it has already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.canonical import attempt_id
from gradewell.functions.response import with_response

#: How a model's failure becomes an attempt: failure -> (status, error code).
FAILURES = {"timeout": ("timeout", "TIMEOUT"), "context_overflow": ("execution_error", "CONTEXT_OVERFLOW"), "budget": ("execution_error", "BUDGET_EXHAUSTED"), "error": ("execution_error", "EXECUTION_ERROR")}


def attempts(outputs: DataFrame, run: Column) -> DataFrame:
    """outputs: case_id, family_id, raw_output, failure (a key of FAILURES or null), and any column passed on. A row that has
    neither text nor failure is a model that returned no string: an execution error."""
    failure = F.coalesce("failure", F.when(F.col("raw_output").isNull(), F.lit("error")))
    parsed = with_response(outputs.withColumn("__failure", failure).withColumn("__raw", F.when(F.col("__failure").isNull(), F.col("raw_output"))), F.col("__raw"), "__parsed")
    code = F.create_map(*[F.lit(x) for k, (_, c) in FAILURES.items() for x in (k, c)])
    state = F.create_map(*[F.lit(x) for k, (s, _) in FAILURES.items() for x in (k, s)])
    return parsed.select(
        *[c for c in outputs.columns if c not in ("raw_output", "failure", "run_id", "attempt_id", "status", "runtime_error_code", "parsed_response", "parse_failure")],
        run.alias("run_id"),
        attempt_id(run, F.col("case_id")).alias("attempt_id"),
        F.when(F.col("__failure").isNotNull(), state[F.col("__failure")]).when(F.col("__parsed.failure").isNotNull(), F.lit("invalid_response")).otherwise(F.lit("completed")).alias("status"),
        F.col("__raw").alias("raw_output"),
        F.col("__parsed.response").alias("parsed_response"),
        F.col("__parsed.failure").alias("parse_failure"),
        code[F.col("__failure")].alias("runtime_error_code"),
    )


def resume_plan(cases: DataFrame, existing: DataFrame) -> DataFrame:
    """cases with `action`: reuse where the run has an attempt already, else run."""
    return cases.join(existing.select("case_id", F.lit("reuse").alias("action")), "case_id", "left").withColumn("action", F.coalesce("action", F.lit("run")))


def resume_faults(cases: DataFrame, existing: DataFrame, run: str) -> DataFrame:
    """(rule, case_id) of attempts that can't be resumed from: another run's, of an unknown case, repeated, of another family."""
    known = cases.select("case_id", F.col("family_id").alias("__family"), F.lit(True).alias("__known"))
    joined = existing.select("case_id", "run_id", "family_id").join(known, "case_id", "left")
    rules = joined.select("case_id", F.explode(F.filter(F.array(
        F.when(F.col("run_id") != run, "other_run"), F.when(F.col("__known").isNull(), "unknown_case"), F.when(F.col("__known") & ~F.col("family_id").eqNullSafe(F.col("__family")), "other_family"),
    ), lambda r: r.isNotNull())).alias("rule"))
    repeated = existing.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("repeated").alias("rule"))
    return rules.unionByName(repeated)


def run_or_resume(cases: DataFrame, existing: DataFrame, generate, run: Column) -> DataFrame:
    """Existing attempts as they are, and new ones for the other cases only: generate(cases) returns outputs."""
    todo = cases.join(existing.select("case_id"), "case_id", "left_anti")
    new = attempts(generate(todo), run)
    return existing.unionByName(new.select(*[c for c in existing.columns if c in new.columns]), allowMissingColumns=True)


def forbidden(cases: DataFrame) -> DataFrame:
    """A generator for replays, which must not call the model: any row it is asked for fails the job."""
    fail = F.raise_error(F.concat(F.lit("replay asked the model for case "), F.col("case_id"))).cast("string")
    return cases.select("case_id", "family_id", fail.alias("raw_output"), F.lit(None).cast("string").alias("failure"))


def select_cases(cases: DataFrame, ids: DataFrame) -> DataFrame:
    """Cases in the order of ids (case_id, pos); `found` is false for an id without a case."""
    return ids.join(cases.withColumn("found", F.lit(True)), "case_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
