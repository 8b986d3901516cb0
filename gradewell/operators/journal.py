"""Intents, receipts and comparisons: joins that decide what may run, what is reused, and what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def journal_states(cases: DataFrame, intents: DataFrame, receipts: DataFrame) -> DataFrame:
    """(case_id, state): neither intent nor receipt: run; both: reuse; an intent alone is unresolved and never run again; a receipt
    alone is an error; so is either for a case that isn't there."""
    both = intents.select("case_id", F.lit(True).alias("i")).join(receipts.select("case_id", F.lit(True).alias("r")), "case_id", "full_outer")
    whole = cases.select("case_id", F.lit(True).alias("c")).join(both, "case_id", "full_outer")
    state = F.when(F.col("c").isNull(), "unknown_case").when(F.col("i") & F.col("r"), "reuse").when(F.col("r"), "receipt_without_intent").when(F.col("i"), "unresolved").otherwise("run")
    return whole.select("case_id", state.alias("state"))


def rebuilt(cases: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts in the order of their cases; a case without a receipt fails the job."""
    joined = cases.join(receipts, "case_id", "left")
    missing = F.when(F.col("attempt").isNull(), F.raise_error(F.concat(F.lit("no receipt for case "), F.col("case_id"))).cast("string"))
    return joined.where(missing.isNull())


def differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, a, b) where two runs differ; null equals null; a row that one lacks differs in `row`."""
    x = a.select(F.col(key), F.lit(True).alias("__a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    y = b.select(F.col(key), F.lit(True).alias("__b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    cell = lambda field, left, right: F.struct(F.lit(field).alias("field"), left.alias("a"), right.alias("b"))
    fields = [cell("row", F.when(F.col("__a"), "present").otherwise("missing"), F.when(F.col("__b"), "present").otherwise("missing"))]
    fields += [cell(c, F.when(F.col("__b"), F.col(f"a_{c}")), F.when(F.col("__a"), F.col(f"b_{c}"))) for c in columns]
    return x.join(y, key, "full_outer").select(key, F.explode(F.array(*fields)).alias("d")).where(~F.col("d.a").eqNullSafe(F.col("d.b"))).select(key, "d.field", "d.a", "d.b")


def digest_faults(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, fault): expected digests (path, sha256) that are missing or differ, and files that nothing expects."""
    joined = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    fault = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.lower("e") != F.lower("a"), "mismatch")
    return joined.select("path", fault.alias("fault")).where("fault IS NOT NULL")


def shape_faults(model: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, fault): tensors that one side lacks, or whose shapes differ."""
    joined = model.select("name", F.col("shape").alias("m"), F.lit(True).alias("__m")).join(stored.select("name", F.col("shape").alias("s"), F.lit(True).alias("__s")), "name", "full_outer")
    fault = F.when(F.col("__s").isNull(), "missing").when(F.col("__m").isNull(), "unexpected").when(~F.col("m").eqNullSafe(F.col("s")), "shape")
    return joined.select("name", fault.alias("fault")).where("fault IS NOT NULL")


def positions_differ(cases: DataFrame, identities: DataFrame) -> DataFrame:
    """Positions at which two ordered lists (pos, case_id) differ or one has ended."""
    joined = cases.select("pos", F.col("case_id").alias("case")).join(identities.select("pos", F.col("case_id").alias("identity")), "pos", "full_outer")
    return joined.where(~F.col("case").eqNullSafe(F.col("identity")))
