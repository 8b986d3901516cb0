"""Row rules as violations: (rule, key). A dataset with any is refused whole; a model's output with faults becomes a row instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A time that names its offset; Spark's timestamps forget whether they had one, so the text is checked.
AWARE = r"(Z|z|[+-]\d\d:?\d\d)$"


def unique(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a rule that is null is broken. No shuffle."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]), lambda r: r.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(rows: DataFrame, key: str, rule: str = "V20") -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def case_rules() -> dict[str, Column]:
    """Over the columns input and gold of a case. Lists that may be left out are empty then."""
    i, g = F.col("input"), F.col("gold")
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    available, permitted = listed(i["available_tools"]), listed(i["permitted_tools"])
    calls = g["expected_decision"] == "CALL_TOOL"
    call = g["expected_tool_call"]
    return {
        "V01": i["evaluation_time_utc"].rlike(AWARE),
        "V02": (F.size(i["languages"]) > 0) & unique(i["languages"]),
        "V03": (F.size(i["messages"]) > 0) & F.exists(i["messages"], lambda m: m["role"] == "user"),
        "V04": unique(available) & unique(permitted),
        "V05": subset(permitted, available),
        "V06": i["evidence"].isNull() | unique(F.transform(i["evidence"], lambda d: d["document_id"])) & F.forall(i["evidence"], lambda d: d["observed_at_utc"].isNull() | d["observed_at_utc"].rlike(AWARE)),
        "V07": calls == call.isNotNull(),
        "V08": call.isNull() | F.array_contains(listed(g["permitted_tools"]), call["tool"]),
        "V09": (i["case_id"] == g["case_id"]) & same_set(permitted, listed(g["permitted_tools"])),
    }


def attempt_rules() -> dict[str, Column]:
    """Which fields an attempt of each status has: exactly one of response and failure if there is a text, none else."""
    raw, parsed, failed, code = (F.col(c).isNotNull() for c in ("raw_output", "parsed_response", "parse_failure", "runtime_error_code"))
    s = F.col("status")
    return {
        "V10": raw == (parsed != failed),
        "V11": F.when(s == "completed", raw & parsed & ~failed & ~code).when(s == "invalid_response", raw & ~parsed & failed & ~code).when(s == "timeout", ~raw & ~parsed & ~failed & (F.col("runtime_error_code") == "TIMEOUT")).when(s == "execution_error", ~raw & ~parsed & ~failed & code & (F.col("runtime_error_code") != "TIMEOUT")),
    }


def score_rules() -> dict[str, Column]:
    return {"V13": F.col("value").isNull() == F.col("missing_reason").isNotNull(), "finite": F.col("value").isNull() | (~F.isnan("value") & (F.abs("value") < float("inf")))}


def observation_rules() -> dict[str, Column]:
    first = ["model_inference_seconds", "input_token_count", "output_token_count", "stop_reason", "prompt_sha256"]
    later = ["input_ids", "generated_ids", "runtime_device", "parameter_dtype", "attention_mode", "model_load_seconds"]
    has = lambda names: F.forall(F.array(*[F.col(n).isNotNull() for n in names]), lambda x: x)
    done, newer = F.col("transport_status") == "completed", F.col("schema_version") == "1.1"
    return {
        "V14": F.col("started_at_utc").rlike(AWARE) & F.col("completed_at_utc").rlike(AWARE) & (F.to_timestamp("completed_at_utc") >= F.to_timestamp("started_at_utc")),
        "V15": ~done | ((F.col("worker_returncode") == 0) & has(first) & (~newer | has(later))),
        "V16": (F.col("transport_status") != "timeout") | F.col("worker_returncode").isNull(),
    }


def result_rules() -> dict[str, Column]:
    ok, error, data, hash_ = F.col("success"), F.col("error_code").isNotNull(), F.col("payload").isNotNull(), F.col("payload_hash").isNotNull()
    return {"V17": F.when(ok, data & hash_ & ~error).otherwise(error & ~data)}


def episode_rules() -> dict[str, Column]:
    """terminal_status, response, parse_failure, error_code."""
    s, response, failure, error = F.col("terminal_status"), F.col("response").isNotNull(), F.col("parse_failure").isNotNull(), F.col("error_code").isNotNull()
    return {"V18": F.when(s == "completed", response & ~failure & ~error).when(s == "invalid_response", ~response & failure).when(s.isin("budget_exhausted", "stagnation"), ~response & error)}


def receipt_rules() -> dict[str, Column]:
    case = F.col("attempt.case_id")
    return {"V19": (F.col("run_id") == F.col("attempt.run_id")) & (case == F.col("observation.case_id")) & (case == F.col("diagnostics.case_id"))}


def policy_rules() -> dict[str, Column]:
    return {"V22": (F.col("max_turns") >= 1) & (F.col("max_calls") >= 0) & (F.col("max_repairs") >= 0)}


def generation_rules() -> dict[str, Column]:
    return {"V23": (F.col("max_new_tokens") >= 1) & (F.col("temperature") > 0) & (F.col("top_p") > 0) & (F.col("top_p") <= 1)}


def fits_context(tokens: Column, new_tokens: Column, limit: int = 4096) -> Column:
    return tokens + new_tokens <= limit


def equal(name: str, a: Column, b: Column) -> Column:
    """Fails the job, naming what differs, unless a equals b (null equals null)."""
    return F.when(a.eqNullSafe(b), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{name} differs: "), F.coalesce(a.cast("string"), F.lit("null")), F.lit(" is not "), F.coalesce(b.cast("string"), F.lit("null")))).cast("boolean"))


def exactly_one(rows: DataFrame, what: str) -> DataFrame:
    """rows, if it is one row; else the job fails."""
    n = rows.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 1, F.lit(1)).otherwise(F.raise_error(F.lit(f"{what}: not exactly one")).cast("int")).alias("one"))
    return rows.join(F.broadcast(n), F.col("one") == 1).drop("one")


def refuse(found: DataFrame) -> None:
    """Raises, with some violations, if there are any."""
    if some := found.limit(20).collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in some))
