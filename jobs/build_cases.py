"""Builds a dataset of evaluation cases from conversations and the documents that back them, and publishes it by split.

    python -m jobs.build_cases --conversations PATH --documents PATH --out FOLDER [--config FILE]

A conversation is a case: its turns in order, the document of the same number as evidence, and the prompt that a model is shown. What breaks
a rule is left out and named: rules of cases (V02: no language, as the document lacks; V03: no turn of a user; V06), `turns` (more than
max_turns), `prompt_chars` (a prompt that is too long), `duplicate` (the prompt of a case with a smaller number). Cases whose first question is the same are a
family and fall into the same split, so no question is in both. Rows without a number are left out, null texts count as empty.

Written, all Parquet: cases by split, rejected by rule, digests by split (of the cases' digests, in 16 parts, so that no task sorts a split).
A run replaces what an earlier one wrote; the same input gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.functions.canonical import canonical, dataset_digest, digest
from gradewell.functions.prompt import prompt
from gradewell.operators.validation import case_rules, violations
from gradewell.sources.places import written
from jobs.common import log, main, read, write


def candidates(turns: DataFrame, documents: DataFrame, settings: dict) -> DataFrame:
    """A row for each conversation of at most max_turns turns."""
    said = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(said)), lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    grouped = turns.groupBy("conv_id").agg(messages.alias("messages"))
    backed = grouped.join(documents.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "conv_id"), "conv_id", "left")
    names = lambda key: F.array(*[F.lit(n) for n in settings[key]]).cast("array<string>")
    document = F.struct(F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("doc-"), F.col("conv_id").cast("string")).alias("document_id"), F.lit(None).cast("string").alias("observed_at_utc"))
    found = F.col("text").isNotNull() | F.col("lang").isNotNull()
    input_ = F.struct(
        names("available_tools").alias("available_tools"), F.when(found, F.array(document)).otherwise(F.array().cast("array<struct<content:string,document_id:string,observed_at_utc:string>>")).alias("evidence"),
        F.filter(F.array("lang"), lambda x: x.isNotNull()).alias("languages"), "messages", names("permitted_tools").alias("permitted_tools"),
    )
    cases = backed.select("conv_id", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("case_id"), input_.alias("input"))
    i = F.col("input")
    text = prompt(i["messages"], i["evidence"], i["available_tools"], i["permitted_tools"])
    first = F.filter(i["messages"], lambda m: m["role"] == "user")
    family = digest(F.when(F.size(first) > 0, first[0]["content"]).otherwise(F.lit("")))
    split = F.when(F.conv(F.substring("family_id", 1, 1), 16, 10).cast("int") < settings["test_sixteenths"], "test").otherwise("development")
    return cases.withColumns({"family_id": family, "prompt": text}).withColumns({"prompt_sha256": digest(F.col("prompt")), "n_chars": F.length("prompt").cast("long"), "n_messages": F.size(i["messages"]).cast("long"), "split": split})


def run(spark: SparkSession, settings: dict, conversations: str, documents: str, out: str) -> dict[str, int]:
    """Builds, checks and publishes cases; returns how many rows each folder got."""
    turns = read(spark, conversations, settings["conversations"]).where("conv_id IS NOT NULL")
    long = turns.groupBy("conv_id").count().where(F.col("count") > settings["max_turns"]).select("conv_id")
    # kept: what follows asks for it several times
    found = written(candidates(turns.join(long, "conv_id", "left_anti"), read(spark, documents, settings["documents"]), settings))
    rules = {name: rule for name, rule in case_rules().items() if name in settings["rules"]} | {"prompt_chars": F.col("n_chars") <= settings["max_prompt_chars"]}
    broken = violations(found, "case_id", rules)
    good = found.join(broken.select(F.col("key").alias("case_id")).distinct(), "case_id", "left_anti")
    # the smallest number of each prompt, then a join by number: cases that many share don't meet in one task
    first = written(good.groupBy("prompt_sha256").agg(F.min("conv_id").alias("conv_id")).select("conv_id"))
    kept, again = good.join(first, "conv_id", "left_semi"), good.join(first, "conv_id", "left_anti")
    rejected = broken.union(long.select(F.lit("turns"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))).union(again.select(F.lit("duplicate"), "case_id"))
    parts = kept.select("split", F.substring("prompt_sha256", 1, 1).alias("part"), F.col("conv_id").alias("pos"), canonical(F.struct("case_id", "prompt_sha256")).alias("json"))
    wrote = {
        "cases": write(kept.select("case_id", "family_id", "n_messages", "n_chars", "prompt_sha256", "prompt", "input", "split"), f"{out}/cases", ("split",)),
        "rejected": write(rejected.select(F.col("key").alias("case_id"), "rule"), f"{out}/rejected", ("rule",)),
        "digests": write(dataset_digest(parts, "pos", "json", ("split", "part")), f"{out}/digests", ("split",)),
    }
    log.info("built %s", wrote)
    return wrote


def published(spark: SparkSession, out: str) -> DataFrame:
    """What stands in the folder: (kind, name, split or rule as label, n, sha256)."""
    cases = spark.read.schema("case_id string, n_chars long, prompt_sha256 string, split string").parquet(f"{out}/cases")
    rejected = spark.read.schema("case_id string, rule string").parquet(f"{out}/rejected")
    digests = spark.read.schema("part string, dataset_sha256 string, n_rows long, split string").parquet(f"{out}/digests")
    rows = cases.select(F.lit("case").alias("kind"), F.col("case_id").alias("name"), F.col("split").alias("label"), F.col("n_chars").alias("n"), F.col("prompt_sha256").alias("sha256"))
    rows = rows.union(rejected.select(F.lit("rejected"), "case_id", "rule", F.lit(None).cast("long"), F.lit(None).cast("string")))
    return rows.union(digests.select(F.lit("digest"), "part", "split", "n_rows", "dataset_sha256"))


if __name__ == "__main__":
    main("build_cases", ("conversations", "documents", "out"), run)
