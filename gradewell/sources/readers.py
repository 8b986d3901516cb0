"""Readers: datasets and configs as JSON, journals, checksum lists, file digests. All paths go through Spark's file systems."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.contracts import contract_faults
from gradewell.operators.validation import case_rules, exactly_one, refuse, repeated, violations
from gradewell.schemas import CASE, INTENT, RECEIPT
from gradewell.sources.arrays import array_items


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of cases (UTF-8, byte order mark allowed) in file order, with `pos` and `case_id`. Any fault of a case against its
    contract (unknown and missing fields, unknown names, values out of bounds) and any broken rule refuses the file."""
    whole = array_items(spark, path)
    key = F.coalesce(F.get_json_object("json", "$.input.case_id"), F.concat(F.lit("#"), F.col("pos").cast("string")))
    cases = lambda mode: whole.select("pos", F.from_json("json", f"struct<{CASE}>", {"mode": mode}).alias("c")).select("pos", "c.*", F.col("c.input.case_id").alias("case_id"))
    loose, rows = cases("PERMISSIVE"), cases("FAILFAST")
    refuse(violations(loose, "case_id", case_rules()).union(repeated(loose, "case_id")).union(case_faults(whole.withColumn("key", key), "key", "json")))
    return rows


def case_faults(rows: DataFrame, key: str, json: str, contract: str = "eval_case") -> DataFrame:
    """(rule, key) of JSON texts against a contract; the rule is the fault and the path."""
    found = rows.select(F.col(key).cast("string").alias("key"), F.explode(contract_faults(F.col(json), contract)).alias("f"))
    return found.select(F.concat_ws(" ", "f.fault", "f.path").alias("rule"), "key")


def read_object(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object as one row; anything else fails the job."""
    reader = spark.read.schema(schema) if schema else spark.read
    return exactly_one(reader.option("multiLine", True).option("mode", "FAILFAST").json(path), path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file, a folder of its parts, or a folder of such."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """A folder with one JSON file for each case."""
    return read_jsonl(spark, path, INTENT)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, RECEIPT).withColumn("case_id", F.col("attempt.case_id"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of lines `digest  path`; a star before the path (binary mode) is dropped, digests are lower-cased."""
    line = spark.read.text(path).where(F.trim("value") != "")
    return line.select(F.regexp_extract("value", r"^\s*\S+\s+\*?(.+?)\s*$", 1).alias("path"), F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1)).alias("sha256"))


def one_checksum(checksums: DataFrame, name: str) -> DataFrame:
    """The digest of exactly one file."""
    return exactly_one(checksums.where(F.col("path") == name), name)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files by their paths, hashed a megabyte at a time."""
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            sha = hashlib.sha256()
            with open(path, "rb") as f:
                while block := f.read(1 << 20):
                    sha.update(block)
            out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(1)], ["path", "sha256", "length"])


def _under(folder: str, path: Column) -> Column:
    """The name, in folder, of the file that a path is or is a part of."""
    return F.regexp_extract(path, rf"^.*/\Q{folder.rstrip('/').rpartition('/')[2]}\E/([^/]+?)(/part-\d+(\.gz)?)?$", 1)


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_lines) of the text files in a folder, each of which ends with a line feed. They are read in pieces that end at commas, so
    that one long line is no row."""
    text = spark.read.text(folder, lineSep=",", recursiveFileLookup=True)
    return text.select(_under(folder, F.col("_metadata.file_path")).alias("path"), F.regexp_count("value", F.lit("\n")).alias("n")).groupBy("path").agg(F.sum("n").alias("n_lines"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256, length) of the files in a folder, by name. Files on disks that every executor sees are read a megabyte at a time, so
    a file may be of any size; those on other stores are read by Spark, whole, one a row (2 GB at most). A folder of parts counts as one
    file; its digest is that of the lines `digest  part` of its parts, in order, so parts are hashed side by side."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
        files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length").mapInArrow(lambda it: _digest(it), "path string, sha256 string, length long")
    else:
        files = files.select("path", F.sha2("content", 256).alias("sha256"), "length")
    named = files.select(_under(where.toString(), F.col("path")).alias("__name"), F.regexp_extract("path", "([^/]+)$", 1).alias("part"), "sha256", "length").where("__name <> ''")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda p: F.concat(p["sha256"], F.lit("  "), p["part"], F.lit("\n"))), "")
    digest = F.when(F.first("part") == F.col("__name"), F.first("sha256")).otherwise(F.sha2(lines, 256))
    return named.groupBy("__name").agg(digest.alias("sha256"), F.sum("length").alias("length")).withColumnRenamed("__name", "path")
