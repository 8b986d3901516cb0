"""Streams give what the batch operators give, and a case runs once."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.operators import episodes, reports
from gradewell.operators.attempts import attempts
from gradewell.operators.scoring import score, with_gold
from gradewell.plans.derived import cases, conversation_cases, outputs  # noqa: F401
from gradewell.streaming import runs


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_metrics(spark, tmp_path):
    made = spark.createDataFrame([(str(i), "f", i, "r", ["click", "error", "view"][i % 3], i % 20) for i in range(60)], "case_id string, family_id string, pos int, run_id string, event_type string, k int")
    made = made.selectExpr("*", "element_at(array('RESPOND', 'REFUSE'), k % 2 + 1) AS expected_decision", "'SUPPORTED' AS expected_answerability", "CAST(NULL AS string) AS expected_tool")
    out, gold = outputs(made), made.select("case_id", "expected_decision", "expected_answerability", "expected_tool")
    out.repartition(3).write.parquet(str(tmp_path / "out"))
    stream = spark.readStream.schema(out.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "out"))
    q = runs.metric_stream(stream, gold, F.col("run_id")).writeStream.outputMode("complete").format("memory").queryName("metrics").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("metrics")) == rows(reports.metric_report(score(with_gold(attempts(out, F.col("run_id")), gold))))


def test_episodes(spark, tmp_path):
    kinds = {"a": ["call", "answer"], "b": ["invalid", "invalid"], "c": ["call", "call", "call"], "d": ["call", "invalid", "call", "invalid"]}
    turns = spark.createDataFrame([(c, i, k) for c, ks in kinds.items() for i, k in enumerate(ks)], "case_id string, turn_index int, kind string")
    for i in range(4):
        turns.where(f"turn_index = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "turns"))
    q = runs.episode_stream(stream).writeStream.outputMode("append").format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("episodes")) == rows(episodes.terminal_states(turns).where("terminal_status <> 'open'"))


def test_at_most_once(spark, tmp_path):
    cases = spark.createDataFrame([("a",), ("b",), ("a",)], "case_id string")
    cases.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("case_id string").parquet(str(tmp_path / "in"))
    execute = lambda df: df.withColumn("raw_output", F.lit("x"))
    for ck in ("one", "two"):  # a second run with a new checkpoint finds the intents
        runs.journaled(stream(), str(tmp_path / "intents"), str(tmp_path / "receipts"), execute, str(tmp_path / ck)).awaitTermination()
    assert sorted(r["case_id"] for r in spark.read.parquet(str(tmp_path / "intents")).collect()) == ["a", "b"]
    assert sorted(r["case_id"] for r in spark.read.parquet(str(tmp_path / "receipts")).collect()) == ["a", "b"]
    assert runs.once_per_case(cases).count() == 2


def test_cases_are_forgotten(spark, tmp_path):
    """Within the delay a case comes once; its state goes when the watermark has passed."""
    made = spark.createDataFrame([("a", 0), ("a", 60), ("b", 30)], "case_id string, at long").selectExpr("case_id", "timestamp_seconds(at) AS at")
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", 10**6)], "case_id string, at long").selectExpr("case_id", "timestamp_seconds(at) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.once_per_case(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "at", "1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["case_id"] for r in spark.table("once").collect()) == ["a", "b", "z"]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
