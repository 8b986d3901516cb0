"""Scores model outputs as files of them arrive, and keeps the metrics of each run up to date.

    python -m jobs.score_outputs --outputs PATH --out FOLDER --checkpoint FOLDER [--config FILE]

--outputs is a folder of Parquet files or a pattern that matches folders or files. Each run takes the files that no run before has taken, as a stream that ends when there are none left; which they are, and how far a run
came, is in the checkpoint. The config says how a row of the files becomes an output with what is expected of it: `columns` (DDL), `where`
and `select` (SQL). Outputs become attempts, attempts four scores each.

Two streams: scores are appended, Parquet by run_id, without state; metrics are sums in a state of one row for each run and metric, and what a batch changes
replaces the run's partition. Both go on from their checkpoints after a failure, and a batch that is tried again writes the same: scores by
the file sink's own log, metrics by overwriting. An output that comes twice, in two files, is two outputs: producers must not send
it again under another name. Rows without a case_id or run_id are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gradewell.operators.attempts import attempts
from gradewell.operators.reports import metric_report
from gradewell.operators.scoring import score
from jobs.common import log, main, write

COLUMNS = ("case_id", "family_id", "run_id", "raw_output", "failure", "expected_decision", "expected_answerability", "expected_tool")
SCORES = "attempt_id string, case_id string, family_id string, status string, metric_id string, eligible boolean, value double, missing_reason string, failure_labels array<string>, run_id string"
METRICS = "metric_id string, total_rows long, eligible_instances long, missing_instances long, estimate double, run_id string"


def scores_of(rows: DataFrame, settings: dict) -> DataFrame:
    """Rows of the files to scores; row by row, so for streams and tables alike."""
    outputs = rows.where(settings["where"]).select(*[F.expr(settings["select"][c]).alias(c) for c in COLUMNS]).where("case_id IS NOT NULL AND run_id IS NOT NULL")
    made = attempts(outputs, F.col("run_id"))
    parsed = {"decision": F.col("parsed_response.decision"), "answerability": F.col("parsed_response.answerability"), "tool": F.col("parsed_response.tool_call.tool")}
    return score(made.withColumns(parsed)).select(*[f.partition(" ")[0] for f in SCORES.split(", ")])


def _watch(query: StreamingQuery, name: str) -> int:
    query.awaitTermination()
    rows = sum(p.numInputRows for p in query.recentProgress)
    log.info("%s: read %d new rows in %d batches", name, rows, len([p for p in query.recentProgress if p.numInputRows]))
    return rows


def run(spark: SparkSession, settings: dict, outputs: str, out: str, checkpoint: str) -> int:
    """Scores what is new; returns how many rows of the files that were."""
    log.info("read %s (stream of parquet): %s", outputs, settings["columns"])
    rows = spark.readStream.schema(settings["columns"]).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(outputs)
    scores = scores_of(rows, settings)
    appended = scores.writeStream.format("parquet").partitionBy("run_id").option("checkpointLocation", f"{checkpoint}/scores").trigger(availableNow=True).start(f"{out}/scores")
    read = _watch(appended, "scores")
    changed = lambda batch, number: write(batch.select(*[f.partition(" ")[0] for f in METRICS.split(", ")]), f"{out}/metrics", ("run_id",), dynamic=True)
    metrics = metric_report(scores, ("run_id",)).writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{checkpoint}/metrics").trigger(availableNow=True).start()
    _watch(metrics, "metrics")
    log.info("wrote %s/scores (parquet by run_id), appended: scores of %d rows", out, read)
    return read


def published(spark: SparkSession, out: str) -> DataFrame:
    """What stands in the folder: a row for each score, and one for each run and metric."""
    scores, metrics = spark.read.schema(SCORES).parquet(f"{out}/scores"), spark.read.schema(METRICS).parquet(f"{out}/metrics")
    of = scores.select("run_id", "metric_id", "case_id", "status", "eligible", "value", "missing_reason", F.array_join("failure_labels", ",").alias("labels"), F.lit(1).cast("long").alias("n"))
    return of.union(metrics.select("run_id", "metric_id", F.lit(None), F.lit(None), F.lit(None), "estimate", F.lit(None), F.lit(None), "eligible_instances"))


if __name__ == "__main__":
    main("score_outputs", ("outputs", "out", "checkpoint"), run)
