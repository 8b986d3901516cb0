"""The jobs: rules and reruns of the one, growing input of the other, and both command lines."""

from __future__ import annotations

import json
import logging
import os
import subprocess
import sys

import pytest

from gradewell.operators.reports import metric_report
from jobs import build_cases, score_outputs
from jobs.common import config

DATA = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TURN = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture
def corpus(spark, tmp_path):
    said = [(k, t, r, f"{r} {k // 2 if k < 6 else k} {t}") for k in range(10) for t, r in enumerate(("system", "user", "assistant"))]  # pairs of equal conversations up to 5
    said += [(20, 0, "assistant", "no question"), (21, 0, "user", "no document"), (22, 0, "user", None), (23, 0, "user", "x" * 30000), (None, 0, "user", "no number"), (24, 0, "user", "no language")]
    said += [(30, t, "user", "again") for t in range(200)]
    docs = [(k, f"document {k // 2 if k < 6 else k}", "en") for k in range(10)] + [(20, "d", "de"), (22, None, "fr"), (23, "d", "en"), (24, "d", None), (30, "d", "en"), (None, "d", "en")]
    spark.createDataFrame(said, TURN).repartition(3).write.parquet(f"{tmp_path}/conversations")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents")
    return str(tmp_path)


def test_build_cases(spark, corpus, caplog):
    caplog.set_level(logging.INFO, "jobs")
    settings = config("build_cases")
    # evidence names the document, so conversations of different numbers only have the same prompt without one
    run = lambda: build_cases.run(spark, settings, f"{corpus}/conversations", f"{corpus}/documents", f"{corpus}/out")
    wrote, first = run(), rows_of(build_cases.published(spark, f"{corpus}/out"))
    found = build_cases.published(spark, f"{corpus}/out").collect()
    rejected = {(r["name"], r["label"]) for r in found if r["kind"] == "rejected"}
    assert rejected == {("conv-20", "V03"), ("conv-21", "V02"), ("conv-24", "V02"), ("conv-23", "prompt_chars"), ("conv-30", "turns")}
    kept = {r["name"] for r in found if r["kind"] == "case"}
    assert kept == {f"conv-{k}" for k in [*range(10), 22]} and wrote["cases"] == 11 and wrote["rejected"] == 5
    assert "read" in caplog.text and f"wrote {corpus}/out/cases" in caplog.text
    assert run() == wrote and rows_of(build_cases.published(spark, f"{corpus}/out")) == first  # and once more, over what is there
    cases = spark.read.parquet(f"{corpus}/out/cases")
    assert cases.groupBy("family_id").agg({"split": "min"}).count() == cases.select("family_id", "split").distinct().count()
    prompt = cases.where("case_id = 'conv-3'").first()["prompt"]
    assert "MESSAGES\nsystem: system 1 0\nuser: user 1 1\nassistant: assistant 1 2\n" in prompt and "\ndoc-3: document 1\n" in prompt


def test_duplicate_prompts(spark, tmp_path):
    """Without evidence equal conversations have equal prompts: the smallest number stays."""
    spark.createDataFrame([(k, 0, "user", f"q{k % 3}") for k in range(12, 0, -1)], TURN).write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    settings = config("build_cases") | {"rules": ["V03"], "test_sixteenths": 16}
    build_cases.run(spark, settings, f"{tmp_path}/c", f"{tmp_path}/d", f"{tmp_path}/out")
    found = build_cases.published(spark, f"{tmp_path}/out").collect()
    assert {r["name"] for r in found if r["kind"] == "case"} == {"conv-1", "conv-2", "conv-3"} and {r["label"] for r in found if r["kind"] == "case"} == {"test"}
    assert sum(r["label"] == "duplicate" for r in found) == 9 and sum(r["n"] for r in found if r["kind"] == "digest") == 3


def test_scores_take_only_what_is_new(spark, tmp_path, caplog):
    """Files are added between runs; each is read once, and after each run all stands as if it had been scored at once."""
    caplog.set_level(logging.INFO, "jobs")
    table = spark.read.parquet(f"{DATA}/conversations.parquet") if os.path.isdir(DATA) else spark.createDataFrame([(k, t, ("user", "assistant")[t % 2], f"t{k}") for k in range(40) for t in range(4)], TURN)
    settings, folder = config("score_outputs") | {"files_per_batch": 2}, str(tmp_path)
    part = lambda k: table.where(f"conv_id % 3 = {k}").repartition(3).write.mode("append").parquet(f"{folder}/in")
    run = lambda: score_outputs.run(spark, settings, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint")
    seen = 0
    for k in range(3):
        part(k)
        n = table.where(f"conv_id % 3 = {k}").count()
        assert run() == n
        seen += n
        assert run() == 0  # nothing is new
        got = score_outputs.published(spark, f"{folder}/out")
        whole = score_outputs.scores_of(spark.read.schema(settings["columns"]).parquet(f"{folder}/in"), settings)
        scores = got.where("case_id IS NOT NULL")
        assert rows_of(scores.select("run_id", "metric_id", "case_id", "status", "eligible", "value")) == rows_of(whole.select("run_id", "metric_id", "case_id", "status", "eligible", "value"))
        assert rows_of(got.where("case_id IS NULL").select("run_id", "metric_id", "value", "n")) == rows_of(metric_report(whole, ("run_id",)).select("run_id", "metric_id", "estimate", "eligible_instances"))
    assert f"read {n} new rows" in caplog.text and "read 0 new rows" in caplog.text
    assert sorted(os.listdir(f"{folder}/out/metrics"))[0:2] != [] and seen == table.count()


def test_scores_after_a_failure(spark, tmp_path, monkeypatch):
    """The second stream fails after the first has ended; the next run scores nothing twice and completes the metrics."""
    spark.createDataFrame([(k, 1, "assistant", f"t{k}") for k in range(50)], TURN).write.parquet(f"{tmp_path}/in")
    settings, run = config("score_outputs"), lambda: score_outputs.run(spark, config("score_outputs"), f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    real = score_outputs.write
    monkeypatch.setattr(score_outputs, "write", lambda *a, **b: (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(Exception, match="no space"):
        run()
    monkeypatch.setattr(score_outputs, "write", real)
    assert run() == 0
    got = score_outputs.published(spark, f"{tmp_path}/out")
    whole = score_outputs.scores_of(spark.read.schema(settings["columns"]).parquet(f"{tmp_path}/in"), settings)
    assert got.where("case_id IS NOT NULL").count() == 200
    assert rows_of(got.where("case_id IS NULL").select("run_id", "metric_id", "value", "n")) == rows_of(metric_report(whole, ("run_id",)).select("run_id", "metric_id", "estimate", "eligible_instances"))


def test_settings_stay(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    spark.createDataFrame([(1, 1, "assistant", "t")], TURN).write.parquet(f"{tmp_path}/in")
    score_outputs.run(spark, config("score_outputs"), f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert before == {k: spark.conf.get(k) for k in before}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_command_lines(tmp_path):
    """Each with a config file of its own."""
    settings = config("build_cases") | {"max_turns": 2}
    (tmp_path / "own.json").write_text(json.dumps(settings))
    env = os.environ | {"PYTHONPATH": HERE, "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    call = lambda *a: subprocess.run([sys.executable, "-m", *a], env=env, cwd=HERE, capture_output=True, text=True, timeout=300)
    one = call("jobs.build_cases", "--conversations", f"{DATA}/conversations.parquet", "--documents", f"{DATA}/documents.parquet", "--out", f"{tmp_path}/cases", "--config", f"{tmp_path}/own.json")
    assert one.returncode == 0 and "wrote" in one.stderr and any(d.startswith("rule=turns") for d in os.listdir(tmp_path / "cases/rejected"))
    two = call("jobs.score_outputs", "--outputs", f"{DATA}/conversations.parque[t]", "--out", f"{tmp_path}/scores", "--checkpoint", f"{tmp_path}/checkpoint")
    assert two.returncode == 0 and "new rows in 1 batches" in two.stderr and any(d.startswith("run_id=") for d in os.listdir(tmp_path / "scores/metrics"))
