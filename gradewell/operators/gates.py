"""Checks of a published bundle against itself, as violations (rule, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.operators.journal import differences, digest_faults
from gradewell.operators.reports import metric_report
from gradewell.operators.validation import score_rules, violations
from gradewell.schemas import SCORE
from gradewell.sources.readers import file_digests, read_checksums, read_jsonl

METRIC = "array<struct<eligible_instances:bigint,estimate:double,metric_id:string,missing_instances:bigint,total_rows:bigint>>"


def bundle_faults(spark: SparkSession, folder: str, expected_files: set[str] | None = None) -> DataFrame:
    """The files that the checksum list names are there with these digests, and no others; the scores keep their rules; the metrics
    follow from the scores; every attempt with labels has a failure row. Empty: the bundle is sound."""
    listed = read_checksums(spark, f"{folder}/checksums.sha256")
    actual = file_digests(spark, folder).where("path <> 'checksums.sha256' AND path NOT LIKE '.%'")
    found = digest_faults(listed, actual).select(F.concat(F.lit("file_"), "fault").alias("rule"), F.col("path").alias("key"))
    if expected_files is not None:
        wanted = spark.createDataFrame([(n,) for n in sorted(expected_files)], "path string")
        found = found.union(wanted.join(actual, "path", "left_anti").select(F.lit("file_set"), "path")).union(actual.select("path").join(wanted, "path", "left_anti").select(F.lit("file_set"), "path"))
    scores = read_jsonl(spark, f"{folder}/scores.jsonl", SCORE)
    stated = spark.read.text(f"{folder}/metrics.json", wholetext=True).select(F.explode(F.from_json("value", METRIC)).alias("m")).select("m.*")
    columns = ["total_rows", "eligible_instances", "missing_instances", "estimate"]
    metrics = differences(metric_report(scores), stated, "metric_id", columns).select(F.concat(F.lit("metric_"), "field").alias("rule"), F.col("metric_id").alias("key"))
    failures = read_jsonl(spark, f"{folder}/failures.jsonl", "case_id string")
    silent = scores.where(F.size("failure_labels") > 0).select("case_id").distinct().join(failures, "case_id", "left_anti").select(F.lit("failure_missing").alias("rule"), F.col("case_id").alias("key"))
    return found.union(metrics).union(silent).union(violations(scores, "case_id", score_rules()))


def tensor_totals(tensors: DataFrame) -> DataFrame:
    """Parameters, and the distinct types and devices, of a table of tensors (name, shape, dtype, device)."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return tensors.agg(F.sum(size).alias("parameters"), F.array_sort(F.collect_set("dtype")).alias("dtypes"), F.array_sort(F.collect_set("device")).alias("devices"))
