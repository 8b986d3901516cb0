"""Aggregates and report rows over attempts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_report(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each metric: rows, those eligible with a value, those without a value, and the mean over the eligible (null if none)."""
    eligible = F.when(F.col("eligible"), F.col("value"))
    return scores.groupBy(*by, "metric_id").agg(
        F.count("*").alias("total_rows"), F.count(eligible).alias("eligible_instances"), F.count_if(F.col("value").isNull()).alias("missing_instances"), F.avg(eligible).alias("estimate")
    )


def run_summary(attempts: DataFrame, expected: Column | int | DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Attempts by status; a status without attempts counts 0. `balanced`: they add up and every case is there once. expected: how many
    cases there should be: one number for all, or a table (by, expected_cases)."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = attempts.groupBy(*by).agg(
        F.count("*").alias("attempted_cases"), n("completed").alias("completed"), n("invalid_response").alias("invalid_responses"), n("timeout").alias("timeouts"), n("execution_error").alias("execution_errors"), F.countDistinct("case_id").alias("__ids")
    )
    known = counts.join(expected, list(by), "left") if isinstance(expected, DataFrame) else counts.withColumn("expected_cases", F.lit(expected) if isinstance(expected, int) else expected)
    return known.withColumn("expected_cases", F.col("expected_cases").cast("long")).withColumn("score_rows", F.col("attempted_cases") * 4).withColumn(
        "balanced", (F.col("expected_cases") == F.col("attempted_cases")) & (F.col("completed") + F.col("invalid_responses") + F.col("timeouts") + F.col("execution_errors") == F.col("attempted_cases")) & (F.col("__ids") == F.col("attempted_cases"))
    ).drop("__ids")


def case_order(rows: DataFrame, by: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """The case ids of a group as one list, in order."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "case_id"))), lambda x: x["case_id"]).alias("case_ids"))


def case_labels(scores: DataFrame) -> DataFrame:
    """Distinct labels of each attempt, sorted; an attempt has four scores, so a group is four rows."""
    return scores.groupBy("run_id", "case_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("failure_labels")))).alias("failure_labels"))


def failure_rows(attempts: DataFrame, scores: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Attempts that did not complete, or whose scores have labels. With gold: expected and observed decision in place of attempt_id."""
    joined = attempts.join(case_labels(scores), ["run_id", "case_id"], "left").withColumn("failure_labels", F.coalesce("failure_labels", F.array().cast("array<string>")))
    failed = joined.where((F.col("status") != "completed") | (F.size("failure_labels") > 0))
    common = ["case_id", "status", F.col("parse_failure.code").alias("parse_error"), F.col("runtime_error_code").alias("runtime_error"), "failure_labels"]
    if gold is None:
        return failed.select("attempt_id", *common)
    return failed.join(gold.select("case_id", "expected_decision"), "case_id", "left").select(*common, "expected_decision", F.col("parsed_response.decision").alias("observed_decision"))


def failed(rows: DataFrame, decisions: bool = False) -> DataFrame:
    """The same from labelled() rows, without a join. decisions: expected and observed decision in place of attempt_id."""
    some = rows.where((F.col("status") != "completed") | (F.size("failure_labels") > 0))
    common = ["case_id", "status", F.col("parse_failure.code").alias("parse_error"), F.col("runtime_error_code").alias("runtime_error"), "failure_labels"]
    return some.select(*common, "expected_decision", F.col("decision").alias("observed_decision")) if decisions else some.select("attempt_id", *common)


def numbered(rows: DataFrame, name: str, by: str, pos: str, parts: int = 64) -> DataFrame:
    """rows with their number within `by`, in the order of pos (a number, unique within by). A part of a group is a range of pos, cut
    where approximate quantiles of all rows are, so a group of any size is numbered by many tasks: within its parts, behind the sizes of the
    parts before."""
    cuts = rows.agg(F.percentile_approx(pos, [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(pos))) if cuts else F.lit(0)
    cut = rows.withColumn("__part", part)
    sizes = cut.groupBy(F.col(by).alias("__by"), F.col("__part").alias("__p")).count()  # groups * parts rows
    before = F.sum("count").over(Window.partitionBy("__by").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.join(sizes.withColumn("__before", F.coalesce(before, F.lit(0))), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    within = F.row_number().over(Window.partitionBy(by, "__part").orderBy(pos))
    return placed.withColumn(name, (F.col("__before") + within).cast("int")).drop("__part", "__by", "__p", "__before", "count")


def event_rows(attempts: DataFrame, cases: DataFrame, actor: str, time_source: str, pos: str = "pos") -> DataFrame:
    """One event for each attempt, numbered in order within its run, at the time that its case names."""
    rows = numbered(attempts.join(cases.select("case_id", "event_time_utc"), "case_id"), "sequence", "run_id", pos)
    return rows.select(
        "sequence", "run_id", "case_id", F.lit(actor).alias("actor"), F.lit("model_attempt").alias("action"), "status", "event_time_utc",
        F.lit(0.0).alias("elapsed_seconds"), F.concat(F.lit("attempt:"), F.col("attempt_id")).alias("artifact_ref"), F.lit(time_source).alias("time_source"),
    )


def timing_rows(receipts: DataFrame) -> DataFrame:
    """Nine columns of text, six decimals, empty for null: one line for each receipt."""
    fixed = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string("%.6f", F.col(c)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return receipts.select(
        "case_id", F.col("status").alias("attempt_status"), "transport_status", fixed("elapsed_seconds").alias("elapsed_seconds"), fixed("model_load_seconds").alias("model_load_seconds"), fixed("model_inference_seconds").alias("model_inference_seconds"),
        text("input_token_count").alias("input_token_count"), text("output_token_count").alias("output_token_count"), text("stop_reason").alias("stop_reason"),
    )


def report_lines(metrics: DataFrame, receipts: DataFrame) -> DataFrame:
    """(part, key, line) of a Markdown report: a table of metrics and one of cases; an em dash for null, `none` for no labels."""
    dash = lambda c: F.coalesce(c, F.lit("—"))
    first = metrics.select(F.lit(1).alias("part"), F.col("metric_id").alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", "metric_id", F.col("eligible_instances").cast("string"), F.col("missing_instances").cast("string"), dash(F.format_string("%.6f", F.col("estimate")))), F.lit(" |")).alias("line"))
    named = F.when(F.size("failure_labels") == 0, F.lit("none")).otherwise(F.array_join("failure_labels", ", "))
    second = receipts.select(F.lit(2).alias("part"), F.col("case_id").alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", "case_id", "status", dash(F.col("observed_decision")), named), F.lit(" |")).alias("line"))
    heads = metrics.sparkSession.createDataFrame([(1, "", "| metric | eligible | missing | estimate |\n|---|---|---|---|"), (2, "", "| case | status | decision | labels |\n|---|---|---|---|")], "part int, key string, line string")
    return heads.union(first).union(second)
