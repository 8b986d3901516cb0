"""Bounded tool episodes, as folds over ordered turns.

A turn is `answer` (a decision that calls no tool), `call` (with a canonical call) or `invalid` (could not be parsed). Every turn counts
against the turns, every call against the calls, every repair (a turn after an invalid one) against the repairs; the first event that goes
over a bound ends the episode. Budgets are counted by running sums, so an episode of any length streams through one sorted pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terminal_states(turns: DataFrame, max_turns: int = 4, max_calls: int = 2, max_repairs: int = 1) -> DataFrame:
    """turns: case_id, turn_index, kind. One row for each episode: its terminal status, the turn that decided it, and what was counted
    up to then: turns, calls and repairs granted. `open`: all turns seen and none decides.

    Per turn: no turn left -> budget_exhausted; answer -> completed; invalid without a repair left -> budget_exhausted;
    call without a call left -> budget_exhausted."""
    by = Window.partitionBy("case_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).over(by)
    counted = turns.withColumns({"__turns": F.count("*").over(by), "__calls": n("call"), "__invalid": n("invalid")})
    verdict = (
        F.when(F.col("__turns") > max_turns, "budget_exhausted").when(F.col("kind") == "answer", "completed")
        .when((F.col("kind") == "invalid") & (F.col("__invalid") > max_repairs), "budget_exhausted").when((F.col("kind") == "call") & (F.col("__calls") > max_calls), "budget_exhausted")
    )
    judged = counted.withColumn("__verdict", verdict)
    # the turn that decides, else the last one
    first = judged.groupBy("case_id").agg(
        F.min(F.when(F.col("__verdict").isNotNull(), F.struct("turn_index", "__verdict", "__turns", "__calls", "__invalid"))).alias("end"),
        F.max(F.struct("turn_index", "__verdict", "__turns", "__calls", "__invalid")).alias("last"),
    )
    at = F.coalesce("end", "last")
    return first.select(
        "case_id", F.coalesce("end.__verdict", F.lit("open")).alias("terminal_status"), at["turn_index"].alias("turn_index"), F.least(at["__turns"], F.lit(max_turns)).cast("long").alias("turns_used"),
        F.least(at["__calls"], F.lit(max_calls)).cast("long").alias("calls_used"), F.least(at["__invalid"], F.lit(max_repairs)).cast("long").alias("repairs_used"),
    )


def stagnation(calls: DataFrame) -> DataFrame:
    """calls (case_id, pos, state_version, call) with `stagnant`: the same call was made before in the same state. An episode's
    state advances with every result, so there it never holds; it is for calls that are tracked on their own."""
    seen = Window.partitionBy("case_id", "state_version", "call").orderBy("pos")
    return calls.withColumn("stagnant", F.row_number().over(seen) > 1)


def tracked(calls: DataFrame, max_calls: int = 2) -> DataFrame:
    """calls with `verdict`: budget_exhausted comes before stagnation; a refused call is counted, but ends what follows."""
    order = Window.partitionBy("case_id").orderBy("pos")
    return stagnation(calls).withColumn("verdict", F.when(F.row_number().over(order) > max_calls, "budget_exhausted").when(F.col("stagnant"), "stagnation").otherwise("ok"))


def call_ids(calls: DataFrame) -> DataFrame:
    """calls with call_id: the case, `tool`, and the call's number in its case."""
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("turn_index"))
    return calls.withColumn("call_id", F.concat_ws(":", "case_id", F.lit("tool"), nth.cast("string")))


def fold(turns: Column, max_turns: int = 4, max_calls: int = 2, max_repairs: int = 1) -> Column:
    """The same judgement over an array of kinds in order, for episodes that are one row: struct<status, turns, calls, repairs>."""
    start = F.struct(F.lit("open").alias("status"), F.lit(0).alias("turns"), F.lit(0).alias("calls"), F.lit(0).alias("repairs"))

    def step(s: Column, kind: Column) -> Column:
        no_turn = s["turns"] >= max_turns
        no_call, no_repair = (kind == "call") & (s["calls"] >= max_calls), (kind == "invalid") & (s["repairs"] >= max_repairs)
        status = F.when(no_turn | no_call | no_repair, "budget_exhausted").when(kind == "answer", "completed").otherwise("open")
        more = lambda yes: F.when(yes, 1).otherwise(0)
        new = F.struct(status.alias("status"), (s["turns"] + more(~no_turn)).alias("turns"), (s["calls"] + more(~no_turn & (kind == "call") & ~no_call)).alias("calls"), (s["repairs"] + more(~no_turn & (kind == "invalid") & ~no_repair)).alias("repairs"))
        return F.when(s["status"] != "open", s).otherwise(new)

    return F.aggregate(turns, start, step)


def nucleus(tokens: DataFrame, top_p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The likeliest tokens (token, p) whose mass before them is at most top_p."""
    upto = Window.partitionBy(*by).orderBy(F.desc("p"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("__mass", F.sum("p").over(upto) - F.col("p")).where(F.col("__mass") <= top_p).drop("__mass")
