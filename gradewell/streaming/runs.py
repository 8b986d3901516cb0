"""Runs as streams: outputs arrive, attempts and scores leave; intents are written before a case runs, receipts after it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradewell.operators.attempts import attempts
from gradewell.operators.reports import metric_report
from gradewell.operators.scoring import score, with_gold


def scored_stream(outputs: DataFrame, gold: DataFrame, run: Column) -> DataFrame:
    """A stream of outputs, joined to the static table of gold: a stream of scores. Row by row, so it needs no state."""
    return score(with_gold(attempts(outputs, run), gold))


def metric_stream(outputs: DataFrame, gold: DataFrame, run: Column) -> DataFrame:
    """Metrics as they stand; its state is a row for each metric."""
    return metric_report(scored_stream(outputs, gold, run))


def once_per_case(outputs: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Later outputs of a case that has one are dropped. event_time: a column of times; a case is forgotten once they are `delay` past its
    first output. Without it every case is remembered for ever."""
    return outputs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["case_id"]) if event_time else outputs.dropDuplicates(["case_id"])


EPISODE = "case_id string, terminal_status string, turn_index int, turns_used long, calls_used long, repairs_used long"


def episode_stream(turns: DataFrame, max_turns: int = 4, max_calls: int = 2, max_repairs: int = 1, idle: int | None = None) -> DataFrame:
    """A stream of turns (case_id, turn_index, kind) to one row for each episode, when it ends. Turns of an episode arrive in order
    from batch to batch; the state is three counters and whether it has ended. idle: milliseconds without a turn after which an episode is
    forgotten, ended or not (for streams that go on: one that ends with its input waits for times that never come); without it every
    episode is remembered for ever."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, calls, repairs, over = state.get if state.exists else (0, 0, 0, False)
        rows = pd.concat(list(batches)).sort_values("turn_index")
        for turn, kind in zip(rows.turn_index, rows.kind, strict=True):
            if over:
                break
            status = None
            if n == max_turns:
                status = "budget_exhausted"
            else:
                n += 1
                if kind == "answer":
                    status = "completed"
                elif kind == "invalid":
                    status, repairs = ("budget_exhausted", repairs) if repairs == max_repairs else (None, repairs + 1)
                else:
                    status, calls = ("budget_exhausted", calls) if calls == max_calls else (None, calls + 1)
            if status:
                over = True
                yield pd.DataFrame([(key[0], status, turn, n, calls, repairs)], columns=["case_id", "terminal_status", "turn_index", "turns_used", "calls_used", "repairs_used"])
        state.update((n, calls, repairs, over))
        if idle is not None:
            state.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy("case_id").applyInPandasWithState(fold, EPISODE, "turns long, calls long, repairs long, over boolean", "append", timeout)


def journaled(cases: DataFrame, intents: str, receipts: str, execute: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs each case of a stream at most once: a batch writes the intents of cases that have none, runs those, writes their receipts.
    A case with an intent and no receipt is unresolved and not run again. All files are Parquet, and what a batch has written is kept."""

    def batch(whole: DataFrame, number: int) -> None:
        spark, df = whole.sparkSession, whole.dropDuplicates(["case_id"]).persist()  # asked twice, read once
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(intents)
        known = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        new = df.select("case_id")
        if known:
            new = new.join(spark.read.parquet(intents).select("case_id"), "case_id", "left_anti")
        token = uuid.uuid4().hex  # of this attempt at the batch: one that is tried again runs nothing that it had begun
        new.select("case_id", F.lit(number).alias("batch"), F.lit(token).alias("token")).write.mode("append").parquet(intents)
        begun = spark.read.parquet(intents).where(F.col("token") == token).select("case_id")
        execute(df.join(begun, "case_id", "left_semi")).write.mode("append").parquet(receipts)
        df.unpersist()

    return cases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
