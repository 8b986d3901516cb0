"""The four simulated tools as joins: a table of calls in, a result for each call out.

A call is judged in this order: a tool that isn't available, one that isn't permitted, an injected fault, then the tool itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.functions.canonical import canonical, folded, payload_digest
from gradewell.schemas import TOOLS
from gradewell.sources.places import written

#: Characters of the blocks that a search is indexed by, at most.
GRAM = 8


def permission_flags(permitted: Column) -> list[Column]:
    """Four booleans, false for what isn't named."""
    return [F.coalesce(F.array_contains(permitted, t), F.lit(False)).alias(t) for t in TOOLS]


def first_match(calls: DataFrame, table: DataFrame, call_key: str, table_key: str, pos: str = "pos") -> DataFrame:
    """calls with a struct `hit`: the row of table with the lowest pos among those of the call's key, or null.
    The table is reduced to one row a key before the join, so a key's rows never meet its calls."""
    first = table.groupBy(F.col(table_key).alias("__key")).agg(F.min_by(F.struct(*table.columns), pos).alias("hit"))
    return calls.join(first, F.col(call_key) == F.col("__key"), "left").drop("__key")


def _blocks(text: Column, size: int) -> Column:
    """The distinct ones of the blocks of this many characters that a text falls into; what is left at its end is none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}"), F.lit(0)))


def search_index(queries: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries (query), not empty; records (record_id, text). Wherever a query stands in a text, each run of 2 * size - 1 of its characters
    holds a whole block of the text. So two tables do, both written: (query, size, at, gram), the runs of `size` characters from each
    place of a query, size being GRAM, or what a short query allows; (gram, record_id), the records that have one as a block."""
    sized = queries.distinct().withColumn("size", F.least(F.lit(GRAM), F.floor((F.length("query") + 1) / 2)).cast("int"))
    places = F.transform(F.sequence(F.lit(1), F.length("query") - F.col("size") + 1), lambda i: F.substring(F.col("query"), i, F.col("size")))
    asked = written(sized.select("query", "size", F.posexplode(places).alias("at", "gram")))
    some = asked.select("size", "gram").distinct()
    sizes = sorted(r["size"] for r in asked.select("size").distinct().collect())  # GRAM numbers at most
    rows = [records.select("record_id", F.explode(_blocks(F.col("text"), n)).alias("gram")).join(some.where(F.col("size") == n), "gram", "left_semi").select("gram", "record_id") for n in sizes]
    return asked, written(reduce(DataFrame.union, rows, records.where("false").select(F.col("text").alias("gram"), "record_id")))


def rarest(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(query, gram): of each query the `size` grams in a row that fewest records have, together; one of them is in every text it is in."""
    counted = asked.join(index.groupBy("gram").count(), "gram", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    lists = counted.groupBy("query", "size").agg(F.array_sort(F.collect_list(F.struct("at", "n", "gram"))).alias("grams"))  # a query's own length
    total = lambda i: F.aggregate(F.slice("grams", i, F.col("size")), F.lit(0).cast("long"), lambda s, g: s + g["n"])
    starts = F.transform(F.sequence(F.lit(1), F.size("grams") - F.col("size") + 1), lambda i: F.struct(total(i).alias("n"), i.alias("at")))
    best = F.slice("grams", F.array_min(starts)["at"], F.col("size"))
    return lists.select("query", F.explode(F.array_distinct(F.transform(best, lambda g: g["gram"]))).alias("gram"))


def search_matches(calls: DataFrame, records: DataFrame) -> DataFrame:
    """calls (call_id, query, as_of_date, limit) by records (record_id, text, observed_at, ..): ranked hits, newest first, then by id
    descending, at most `limit` for each call (5 where null). Records meet queries in an index of blocks of characters (gram, record): each
    query takes the records of its rarest grams, and these are asked whether they hold the whole of it. An empty query is in every text. All
    steps are joins by equality; no query reaches the driver. Distinct queries are searched once, and a call keeps its best rows before
    they are shuffled. The blocks of a text are one array in its task."""
    c = calls.select("call_id", folded(F.col("query")).alias("__q"), "as_of_date", F.coalesce("limit", F.lit(5)).alias("__limit"))
    r = records.where("text IS NOT NULL").withColumn("__text", folded(F.col("text")))
    asked, index = search_index(c.where("__q <> ''").select(F.col("__q").alias("query")), r.select("record_id", F.col("__text").alias("text")))
    found = rarest(asked, index).join(index, "gram").select(F.col("query").alias("__q"), F.col("record_id").alias("__id")).distinct()
    every = r.join(found, F.col("record_id").eqNullSafe(F.col("__id"))).where(F.contains("__text", "__q")).drop("__id", "__text")
    if not c.where("__q = ''").isEmpty():
        every = every.unionByName(r.drop("__text").withColumn("__q", F.lit("")))
    hit = every.join(c, "__q").where(F.col("as_of_date").isNull() | (F.col("observed_at") <= F.col("as_of_date")))
    ranked = hit.withColumn("rank", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("observed_at"), F.desc("record_id"))))
    return ranked.where((F.col("rank") <= F.col("__limit")) & (F.col("rank") <= 10)).drop("__q", "__limit")


def calculated(operation: Column, left: Column, right: Column) -> Column:
    """struct<result, error_code>: dividing by zero, and a result that isn't finite, are argument errors."""
    value = F.when(operation == "add", left + right).when(operation == "subtract", left - right).when(operation == "multiply", left * right).when((operation == "divide") & (right != 0), F.try_divide(left, right))
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.struct(F.when(~bad, value).alias("result"), F.when(bad, F.lit("ARGUMENT_INVALID")).alias("error_code"))


def gate(available: Column, permitted: Column, tool: Column, fault: Column) -> Column:
    """The error that comes before the tool itself, or null."""
    return F.when(~F.coalesce(F.array_contains(available, tool), F.lit(False)), F.lit("INVALID_TOOL")).when(~F.coalesce(F.array_contains(permitted, tool), F.lit(False)), F.lit("PERMISSION_DENIED")).otherwise(fault)


def with_fault(calls: DataFrame, faults: DataFrame) -> DataFrame:
    """calls with `fault`: the error code of the first fault for the call's tool, in its case where faults have a case_id."""
    keys = ["case_id", "tool"] if "case_id" in faults.columns else ["tool"]
    first = faults.groupBy(*keys).agg(F.min_by("error_code", "pos").alias("fault"))
    return calls.join(F.broadcast(first) if keys == ["tool"] else first, keys, "left")


def record_json(r: Column) -> Column:
    return F.struct(r["authoritative"].alias("authoritative"), F.date_format(r["observed_at"], "yyyy-MM-dd").alias("observed_at"), r["record_id"].alias("record_id"), r["text"].alias("text"))


def simulate(calls: DataFrame, records: DataFrame, statuses: DataFrame, faults: DataFrame) -> DataFrame:
    """calls: call_id, case_id, tool, available, permitted, and the arguments query, as_of_date, limit, record_id, subject_id, operation,
    left, right. Fixtures hold for the case they name. Returns call_id, tool, success, error_code, payload (canonical JSON), payload_hash."""
    judged = with_fault(calls, faults).withColumn("gate", gate(F.col("available"), F.col("permitted"), F.col("tool"), F.col("fault")))
    live = judged.where("gate IS NULL")
    key = lambda case, name: F.concat_ws("\x1f", case, name)
    got = first_match(live.where("tool = 'get_record'").withColumn("__k", key("case_id", "record_id")), records.withColumn("k", key("case_id", "record_id")), "__k", "k")
    got = got.select("call_id", F.when(F.col("hit").isNotNull(), canonical(F.struct(F.lit("get_record").alias("kind"), record_json(F.col("hit")).alias("record")))).alias("payload"), F.when(F.col("hit").isNull(), "NOT_FOUND").alias("error"))
    seen = first_match(live.where("tool = 'lookup_status'").withColumn("__k", key("case_id", "subject_id")), statuses.withColumn("k", key("case_id", "subject_id")), "__k", "k")
    status = F.struct(F.date_format("hit.observed_at", "yyyy-MM-dd").alias("observed_at"), F.col("hit.status").alias("status"), F.col("hit.subject_id").alias("subject_id"))
    seen = seen.select("call_id", F.when(F.col("hit").isNotNull(), canonical(F.struct(F.lit("lookup_status").alias("kind"), status.alias("status")))).alias("payload"), F.when(F.col("hit").isNull(), "NOT_FOUND").alias("error"))
    sums = live.where("tool = 'calculate'").withColumn("c", calculated(F.col("operation"), F.col("left"), F.col("right")))
    sums = sums.select("call_id", F.when(F.col("c.error_code").isNull(), canonical(F.struct(F.lit("calculate").alias("kind"), F.col("c.result").alias("result")))).alias("payload"), F.col("c.error_code").alias("error"))
    asked = live.where("tool = 'search_records'")
    own = asked.select("call_id", F.col("case_id").alias("__case"), "query", "as_of_date", F.least(F.coalesce("limit", F.lit(5)), F.lit(10)).alias("n"))
    hits = own.join(records, F.col("__case") == F.col("case_id")).where(F.contains(folded(F.col("text")), folded(F.col("query"))) & (F.col("as_of_date").isNull() | (F.col("observed_at") <= F.col("as_of_date"))))
    hits = hits.withColumn("r", F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("observed_at"), F.desc("record_id")))).where("r <= n AND r <= 10")
    lists = hits.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", record_json(F.struct(*records.columns)).alias("record")))), lambda x: x["record"]).alias("records"))
    empty = F.from_json(F.lit("[]"), "array<struct<authoritative:boolean,observed_at:string,record_id:string,text:string>>")
    found = asked.select("call_id").join(lists, "call_id", "left").select("call_id", canonical(F.struct(F.lit("search_records").alias("kind"), F.coalesce("records", empty).alias("records"))).alias("payload"), F.lit(None).cast("string").alias("error"))
    bodies = got.unionByName(seen).unionByName(sums).unionByName(found)
    out = judged.select("call_id", "tool", "gate").join(bodies, "call_id", "left")
    error = F.coalesce("gate", "error")
    return out.select("call_id", "tool", error.isNull().alias("success"), error.alias("error_code"), F.when(error.isNull(), F.col("payload")).alias("payload"), F.when(error.isNull(), payload_digest(F.col("payload"))).alias("payload_hash"))
