"""Whole tool episodes: model, parser, budgets and tools by turns, for all cases at once.

Turns are rounds over the episodes that are still open: a few joins of tables, at most max_turns + 1 times, whatever the number of cases.
What a round leaves is checkpointed, so a lost executor asks the model nothing again that it has answered."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.functions.canonical import canonical
from gradewell.functions.response import with_response
from gradewell.operators.tools import simulate
from gradewell.schemas import RESPONSE
from gradewell.sources.places import cut


def result_json(call_id: Column, tool: Column, success: Column, error: Column, payload: Column, hash_: Column) -> Column:
    """Canonical JSON of a tool result; the payload is JSON already."""
    field = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    parts = [F.concat(F.lit('{"call_id":'), quoted(call_id)), F.when(success, field("data", payload)), F.when(~success, field("error_code", quoted(error))), F.when(success, field("payload_hash", quoted(hash_)))]
    tail = F.concat(F.lit(',"schema_version":"1.0","success":'), success.cast("string"), F.lit(',"tool":'), quoted(tool), F.lit("}"))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts], tail)


def run_episodes(cases: DataFrame, generate: Callable[[DataFrame], DataFrame], records: DataFrame, statuses: DataFrame, faults: DataFrame, max_turns: int = 4, max_calls: int = 2, max_repairs: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cases: case_id, available, permitted, and what the model needs. generate: gets those with `results` (canonical JSON of tool
    results so far), `repairing` and the text that failed, and returns case_id, raw_output.

    Returns episodes (case_id, terminal_status, error_code, parse_failure, response, turns, calls, repairs), turns (case_id, turn_index,
    kind, raw_output, response, parse_failure) and results (call_id, case_id, tool, success, error_code, payload, payload_hash).
    A repair takes a turn. The budget of calls is judged before a call is made; a tool's error doesn't end an episode."""
    own = cases.columns
    none = F.lit(None).cast("string")
    state = cut(cases.withColumns({"turns": F.lit(0), "calls": F.lit(0), "repairs": F.lit(0), "results": F.array().cast("array<string>"), "repairing": F.lit(False), "failed_output": none}))
    done, turns, results = [], [], []
    for turn in range(1, max_turns + 2):
        if turn > max_turns:
            ended = with_response(state, F.col("failed_output"), "p")
            done.append(ended.select("case_id", F.lit("budget_exhausted").alias("terminal_status"), F.lit("BUDGET_EXHAUSTED").alias("error_code"), F.col("p.failure").alias("parse_failure"), F.lit(None).cast(RESPONSE).alias("response"), "turns", "calls", "repairs"))
            break
        said = generate(state.select(*own, "results", "repairing", "failed_output")).select("case_id", "raw_output")
        seen = cut(with_response(state.join(said, "case_id"), F.col("raw_output"), "p").withColumn("turns", F.col("turns") + 1))
        turns.append(seen.select("case_id", F.lit(turn).alias("turn_index"), F.when(F.col("repairing"), "repair").otherwise("generate").alias("kind"), "raw_output", F.col("p.response").alias("response"), F.col("p.failure").alias("parse_failure")))
        bad, call = F.col("p.response.decision").isNull(), F.col("p.response.decision") == "CALL_TOOL"
        status = F.when(bad & (F.col("repairs") >= max_repairs), "budget_exhausted").when(~bad & ~call, "completed").when(call & (F.col("calls") >= max_calls), "budget_exhausted")
        judged = seen.withColumn("status", status)
        done.append(judged.where("status IS NOT NULL").select("case_id", F.col("status").alias("terminal_status"), F.when(F.col("status") != "completed", "BUDGET_EXHAUSTED").alias("error_code"), F.col("p.failure").alias("parse_failure"), F.when(F.col("status") == "completed", F.col("p.response")).alias("response"), "turns", "calls", "repairs"))
        live = judged.where("status IS NULL")
        to_repair = live.where(F.col("p.response").isNull()).select(*own, "turns", "calls", (F.col("repairs") + 1).alias("repairs"), "results", F.lit(True).alias("repairing"), F.col("raw_output").alias("failed_output"))
        a = F.col("p.response.tool_call.arguments")
        asked = live.where(F.col("p.response").isNotNull()).withColumn("call_id", F.concat_ws(":", "case_id", F.lit("tool"), (F.col("calls") + 1).cast("string")))
        calls = asked.select("call_id", "case_id", F.col("p.response.tool_call.tool").alias("tool"), "available", "permitted", a["query"].alias("query"), a["as_of_date"].cast("date").alias("as_of_date"), a["limit"].alias("limit"), *[a[n].alias(n) for n in ("record_id", "subject_id", "operation", "left", "right")])
        got = cut(simulate(calls, records, statuses, faults))
        results.append(got.join(calls.select("call_id", "case_id"), "call_id"))
        line = result_json(F.col("call_id"), F.col("tool"), F.col("success"), F.col("error_code"), F.col("payload"), F.col("payload_hash"))
        went_on = asked.join(got.select("call_id", line.alias("line")), "call_id").select(*own, "turns", (F.col("calls") + 1).alias("calls"), "repairs", F.concat("results", F.array("line")).alias("results"), F.lit(False).alias("repairing"), none.alias("failed_output"))
        state = cut(to_repair.unionByName(went_on))
        if state.isEmpty():
            break
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    return together(done), together(turns), together(results)


def canonical_call(call: Column) -> Column:
    """A tool call as canonical JSON, nulls left out: what a tracker compares."""
    return canonical(call)
