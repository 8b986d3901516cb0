"""Evaluation data derived from the driver's tables, by rules that SQL can state as well.

Each event is a case: `k` from its props gives the decision, answerability and tool that are expected, its type what the model says.
Conversations give messages and episodes, documents records and files, orders statuses, line items sums, benchmark items searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.schemas import ANSWERABILITIES, DECISIONS, TOOLS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("case_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("family_id"), F.col("event_id").alias("pos"), "k", "event_type", "value",
        F.concat(F.lit("run-"), (F.col("k") % 3).cast("string")).alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("event_time_utc"),
        pick(DECISIONS, F.col("k") % 4).alias("expected_decision"), pick(ANSWERABILITIES, F.col("k") % 5).alias("expected_answerability"),
        F.when(F.col("k") % 4 == 1, pick(TOOLS, F.floor(F.col("k") / 4) % 4)).alias("expected_tool"),
    )


def _call(tool: Column) -> Column:
    arguments = F.when(tool == "search_records", '{"query":"q"}').when(tool == "get_record", '{"record_id":"r"}').when(tool == "calculate", '{"operation":"add","left":1,"right":2}').otherwise('{"subject_id":"s"}')
    return F.concat(F.lit(',"tool_call":{"tool":"'), tool, F.lit('","arguments":'), arguments, F.lit("}}"))


def outputs(of: DataFrame) -> DataFrame:
    """What the model says about each case: click: what is expected; view: an answer; purchase: a record call; signup: a refusal;
    error: by pos, a timeout, an overflow, broken JSON, another error."""
    kind, decision = F.col("event_type"), F.col("expected_decision")
    head = lambda d, a: F.concat(F.lit('{"decision":"'), d, F.lit('","answerability":"'), a, F.lit('"'))
    right = F.concat(head(decision, F.col("expected_answerability")), F.when(decision == "CALL_TOOL", _call(F.col("expected_tool"))).when(decision == "RESPOND", ',"answer":"a"}').when(decision == "REFUSE", ',"reason":"r"}').otherwise(',"question":"q"}'))
    raw = (
        F.when(kind == "click", right).when(kind == "view", F.concat(head(F.lit("RESPOND"), F.lit("SUPPORTED")), F.lit(',"answer":"v"}')))
        .when(kind == "purchase", F.concat(head(F.lit("CALL_TOOL"), F.col("expected_answerability")), _call(F.lit("get_record")))).when(kind == "signup", F.concat(head(F.lit("REFUSE"), F.lit("NOT_APPLICABLE")), F.lit(',"reason":"s"}')))
        .when(F.col("pos") % 4 == 2, '{"decision":')
    )
    failure = F.when(kind == "error", F.when(F.col("pos") % 4 == 0, "timeout").when(F.col("pos") % 4 == 1, "context_overflow").when(F.col("pos") % 4 == 3, "error"))
    return of.select("case_id", "family_id", "pos", "run_id", raw.alias("raw_output"), failure.alias("failure"))


#: Texts that the parser is shown, by turns, and the code of each (None: valid).
TEXTS = (
    ("  ", "PARSE_ERROR"),
    ('{"decision":', "PARSE_ERROR"),
    ("[1]", "PARSE_ERROR"),
    ('{"decision":"RESPOND","answerability":"SUPPORTED","answer":"x"}', None),
    ('{"decision":"RESPOND","answerability":"SUPPORTED","answer":"x","more":1}', "UNKNOWN_FIELD"),
    ('{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","tool_call":{"tool":"fly","arguments":{}}}', "INVALID_TOOL"),
    ('{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","tool_call":{"tool":"get_record","arguments":{}}}', "ARGUMENT_INVALID"),
    ('{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","more":1,"tool_call":{"tool":"fly","arguments":{}}}', "UNKNOWN_FIELD"),
    ('{"decision":"respond","answerability":"SUPPORTED","answer":"x","more":1}', "PARSE_ERROR"),
    ('{"decision":"RESPOND","answerability":"SUPPORTED","answer":"x","claims":null}', "PARSE_ERROR"),
    ('{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","tool_call":{"tool":"calculate","arguments":{"operation":"add","left":"10","right":true}}}', None),
    ('{"decision":"CALL_TOOL","answerability":"NOT_APPLICABLE","tool_call":{"tool":"search_records","arguments":{"query":"x","limit":11}}}', "ARGUMENT_INVALID"),
)


def conversation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from conversations, with rules broken where conv_id divides by certain numbers."""
    c = table(spark, sf_dir, "conversations")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("text").alias("content"), "role").alias("m")))), lambda x: x["m"])
    grouped = c.where((F.col("conv_id") % 10 != 0) | (F.col("role") != "user")).groupBy("conv_id").agg(messages.alias("messages"))
    if_ = lambda n, yes, no: F.when(F.col("conv_id") % n == 0, yes).otherwise(no)
    texts = lambda *t: F.array(*[F.lit(x) for x in t])
    id_ = F.col("conv_id").cast("string")
    document = lambda name: F.struct(F.lit("fact").alias("content"), F.lit(name).alias("document_id"), F.lit("2024-01-01T00:00:00Z").alias("observed_at_utc"))
    permitted = if_(13, texts("calculate", "get_record"), texts("get_record"))
    call = F.struct(if_(23, F.lit("lookup_status"), F.lit("get_record")).alias("tool"))
    return grouped.select(
        id_.alias("case_id"),
        F.struct(
            if_(11, texts("get_record", "get_record"), texts("get_record", "search_records")).alias("available_tools"), id_.alias("case_id"), if_(7, F.lit("2026-01-15T12:00:00"), F.lit("2026-01-15T12:00:00Z")).alias("evaluation_time_utc"),
            if_(17, F.array(document("d1"), document("d1")), F.array(document("d1"), document("d2"))).alias("evidence"), if_(9, texts("en", "en"), texts("en")).alias("languages"), "messages", permitted.alias("permitted_tools"),
        ).alias("input"),
        F.struct(if_(29, F.lit("other"), id_).alias("case_id"), F.lit("CALL_TOOL").alias("expected_decision"), if_(19, F.lit(None), call).alias("expected_tool_call"), permitted.alias("permitted_tools")).alias("gold"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record_id"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("observed_at"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("call_id"), F.substring("text", 1, 12).alias("query"),
        F.when(F.col("item_id") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") * 7 % 400).cast("int"))).alias("as_of_date"), (F.col("item_id") % 10 + 1).cast("int").alias("limit"),
    )
