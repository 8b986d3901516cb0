"""Writers of report bundles: canonical JSON lines, CSV, checksums, Markdown, schemas; staged, then published as a whole.

Every file is written by Spark into a part folder and then renamed on its file system, so paths may be on any store that Spark writes.
What is larger than a part becomes a folder of the file's name, with numbered parts; no task writes, and none reads, a whole large file.
In bundles such parts are gzip files (their lines repeat much), which Spark's readers unpack. Two runs over the same rows write the same bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradewell.contracts import ALL, json_schema
from gradewell.functions.canonical import canonical, case_digest
from gradewell.schemas import CONTRACTS
from gradewell.sources.places import unshuffled
from gradewell.sources.readers import file_digests


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


#: Bytes of one part, about, before it is packed. A file of more is a folder of its name, with parts part-00000, part-00001, .. (packed:
#: part-00000.gz, ..) which, one after another, are the file.
PART_BYTES = 64 << 20


_PACKED = ".gz"


def _publish(spark: SparkSession, folder: str, path: str) -> None:
    """The parts that Spark wrote into folder, as one file at path, or as a folder of numbered parts."""
    fs, target = _hadoop(spark, path)
    _, source = _hadoop(spark, folder)
    parts = sorted((f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()) if fs.exists(source) else []
    if not parts:
        fs.create(target, False).close()  # fails if someone else was first
        return
    if len(parts) > 1:
        _, parent = _hadoop(spark, f"{folder}.parts")
        fs.mkdirs(parent)
        for k, p in enumerate(parts):
            if not fs.rename(p, _hadoop(spark, f"{folder}.parts/part-{k:05d}{_PACKED if p.getName().endswith(_PACKED) else ''}")[1]):
                raise OSError(f"could not publish {path}")
    if fs.exists(target) or not fs.rename(parts[0] if len(parts) == 1 else parent, target):
        raise FileExistsError(path)


def _in_parts(spark: SparkSession, lines: DataFrame, folder: str, order: list[str]) -> tuple[DataFrame, int, int]:
    """lines with their number `rank` in order, the number of lines, and how many make a part. They are sorted into many files of a table in
    folder; a line's number is its place in its file, behind the files before. So parts are cut by rows alone, and two runs cut the same.
    Rows that order leaves equal go by a hash of their lines."""
    with unshuffled(spark):
        lines.orderBy(*order, F.xxhash64("line")).select("line").write.option("compression", "zstd").parquet(folder)
    placed = spark.read.schema("line string").parquet(folder).select("line", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = placed.groupBy("__file").agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes")).orderBy("__file").collect()  # a row for each task that wrote
    before, n = [], 0
    for r in sizes:
        before.append((r["__file"], n))
        n += r["n"]
    each = max(1, PART_BYTES * n // max(1, sum((r["bytes"] or 0) + r["n"] for r in sizes)))
    ranked = placed.join(F.broadcast(spark.createDataFrame(before, "__file string, __before long")), "__file").select("line", (F.col("__before") + F.col("__row")).alias("rank"))
    return ranked, n, each


def _write_parts(ranked: DataFrame, n: int, each: int, folder: str, sep: str = "\n", packed: bool = False) -> None:
    """Lines as parts of `each`, a task and a file each."""
    with unshuffled(ranked.sparkSession):
        ranked.repartitionById(-(-n // each), F.floor(F.col("rank") / each).cast("int")).sortWithinPartitions("rank").select("line").write.option("lineSep", sep).option("compression", "gzip" if packed else "none").text(folder)


def write_lines(lines: DataFrame, path: str, order: list[str], parse: bool = False, packed: bool = False) -> None:
    """The column `line`, in order, as one text file at path, or as a folder of parts if there is much; refuses to overwrite. parse: each
    line is JSON, and is read again before the file gets its name. packed: parts, if there are any, are gzip files; one file is plain text."""
    spark = lines.sparkSession
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    _, folder = _hadoop(spark, part)
    try:
        ranked, n, each = _in_parts(spark, lines, f"{part}/rows", order)
        if n:
            _write_parts(ranked, n, each, f"{part}/text", packed=packed and n > each)
            if parse:  # what is published must parse: it is read again before it gets its name
                spark.read.schema("gradewell_any string").option("mode", "FAILFAST").json(f"{part}/text").agg(F.count("gradewell_any")).collect()
        _publish(spark, f"{part}/text", path)
    finally:
        fs.delete(folder, True)


def write_jsonl(rows: DataFrame, path: str, order: list[str], columns: list[str] | None = None, packed: bool = False) -> None:
    """Rows as canonical JSON lines: columns in alphabetical order, nulls left out."""
    names = sorted(columns or rows.columns)
    write_lines(rows.withColumn("line", canonical(F.struct(*names))), path, order, True, packed)


def write_object(row: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """One row as one JSON object."""
    write_lines(row.withColumn("line", F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": str(not keep_nulls).lower()})), path, ["line"], True)


def write_array(rows: DataFrame, path: str, order: list[str], keep_nulls: bool = True, packed: bool = False) -> None:
    """Rows as one JSON array, on one line. If there is much, its parts are items with a comma after each; the last item is a part of its own.
    packed: as in write_lines."""
    spark = rows.sparkSession
    fs, target = _hadoop(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path}.part-{uuid.uuid4().hex}"
    _, folder = _hadoop(spark, part)
    try:
        items = rows.withColumn("line", F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": str(not keep_nulls).lower()}))
        ranked, n, each = _in_parts(spark, items, f"{part}/rows", order)
        line = F.concat(F.when(F.col("rank") == 0, "[").otherwise(""), "line", F.when(F.col("rank") == n - 1, "]").otherwise(""))
        if n <= each:  # fits one part
            ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
            ranked.agg(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("line")).coalesce(1).write.text(f"{part}/text")
        else:
            _write_parts(ranked.withColumn("line", line).where(F.col("rank") < n - 1), n - 1, each, f"{part}/text", ",", packed)
            ranked.withColumn("line", line).where(F.col("rank") == n - 1).select("line").coalesce(1).write.option("compression", "gzip" if packed else "none").text(f"{part}/last")
            last = next(f.getPath() for f in fs.listStatus(_hadoop(spark, f"{part}/last")[1]) if f.getPath().getName().startswith("part-"))
            if not fs.rename(last, _hadoop(spark, f"{part}/text/part-{-(-(n - 1) // each):05d}{_PACKED if packed else ''}")[1]):
                raise OSError(f"could not publish {path}")
        _publish(spark, f"{part}/text", path)
    finally:
        fs.delete(folder, True)


def write_csv(rows: DataFrame, path: str, order: list[str], columns: list[str], packed: bool = False) -> None:
    """Text columns as CSV with a header; fields with a comma, quote or line end are quoted."""
    cell = lambda c: F.when(F.col(c).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    body = rows.select(F.lit(1).alias("__part"), *order, F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))
    head = rows.sparkSession.range(1).select(F.lit(0).alias("__part"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.lit(",".join(columns)).alias("line"))
    write_lines(head.union(body), path, ["__part", *order], packed=packed)


def write_checksums(spark: SparkSession, folder: str, name: str = "checksums.sha256") -> None:
    """Digests of all files of a folder but the list itself, by name."""
    rows = file_digests(spark, folder).where((F.col("path") != name) & ~F.col("path").startswith("."))
    write_lines(rows.withColumn("line", F.concat_ws("  ", "sha256", "path")), f"{folder}/{name}", ["path"])


def timing_reference(attempts: DataFrame) -> DataFrame:
    """The timing of a scripted run: nothing is measured."""
    return attempts.select("case_id", F.col("status").alias("attempt_status"), F.lit("0.000000").alias("elapsed_seconds"), F.lit("synthetic_reference_zero").alias("timing_mode"))


class Bundle:
    """Files written into a staging folder beside the target; publish() checks that they are the ones wanted, adds checksums and renames the folder."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        fs, p = _hadoop(spark, self.target)
        if fs.exists(p) and fs.listStatus(p):
            raise FileExistsError(f"{target} is not empty")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.staging}/{name}"

    def publish(self, names: set[str]) -> None:
        write_checksums(self.spark, self.staging)
        fs, staging = _hadoop(self.spark, self.staging)
        found = {f.getPath().getName() for f in fs.listStatus(staging) if not f.getPath().getName().startswith(".")}
        if found != names | {"checksums.sha256"}:
            raise ValueError(f"files differ: {sorted(found ^ (names | {'checksums.sha256'}))}")
        _, target = _hadoop(self.spark, self.target)
        fs.delete(target, False)
        fs.mkdirs(target.getParent())
        if not fs.rename(staging, target):
            raise OSError(f"could not publish {self.target}")


def write_run_bundle(spark: SparkSession, target: str, *, config: DataFrame, environment: DataFrame, manifest: DataFrame, inputs: DataFrame, outputs: DataFrame, scores: DataFrame, metrics: DataFrame, events: DataFrame, failures: DataFrame, timing: DataFrame) -> None:
    """The eleven files of a run. outputs and events carry `pos` for their order, which is not written."""
    b = Bundle(spark, target)
    write_jsonl(scores, b.path("scores.jsonl"), ["case_id", "metric_id"], packed=True)  # the largest, while the others take no disk
    for name, row in (("resolved_config.json", config), ("environment.json", environment), ("manifest.json", manifest)):
        write_object(row, b.path(name))
    write_array(inputs.drop("pos"), b.path("inputs_manifest.json"), ["case_id"], packed=True)
    write_jsonl(outputs, b.path("outputs.jsonl"), ["pos"], [c for c in outputs.columns if c != "pos"], packed=True)
    write_array(metrics, b.path("metrics.json"), ["metric_id"])
    write_jsonl(events, b.path("events.jsonl"), ["sequence"], packed=True)
    write_lines(failures.withColumn("line", F.to_json(F.struct(*sorted(failures.columns)), {"ignoreNullFields": "false"})), b.path("failures.jsonl"), ["case_id"], packed=True)
    write_csv(timing, b.path("timing.csv"), ["case_id"], timing.columns, packed=True)
    b.publish({"resolved_config.json", "environment.json", "manifest.json", "inputs_manifest.json", "outputs.jsonl", "scores.jsonl", "metrics.json", "events.jsonl", "failures.jsonl", "timing.csv"})


def write_pilot_bundle(spark: SparkSession, target: str, *, manifest: DataFrame, receipts: DataFrame, scores: DataFrame, metrics: DataFrame, failures: DataFrame, timing: DataFrame, report: DataFrame) -> None:
    """The eight files of a journaled run. report: (part, key, line)."""
    b = Bundle(spark, target)
    write_object(manifest, b.path("run_manifest.json"))
    write_jsonl(receipts, b.path("case_receipts.jsonl"), ["case_id"], packed=True)
    write_jsonl(scores, b.path("scores.jsonl"), ["case_id", "metric_id"], packed=True)
    write_array(metrics, b.path("metrics.json"), ["metric_id"])
    write_lines(failures.withColumn("line", F.to_json(F.struct(*sorted(failures.columns)), {"ignoreNullFields": "false"})), b.path("failures.jsonl"), ["case_id"], packed=True)
    write_csv(timing, b.path("timing.csv"), ["case_id"], timing.columns, packed=True)
    write_lines(report, b.path("BASELINE_REPORT.md"), ["part", "key"], packed=True)
    b.publish({"run_manifest.json", "case_receipts.jsonl", "scores.jsonl", "metrics.json", "failures.jsonl", "timing.csv", "BASELINE_REPORT.md"})


def export_schemas(spark: SparkSession, folder: str) -> None:
    """The Spark schema of each table, as JSON."""
    for name, schema in CONTRACTS.items():
        write_lines(spark.createDataFrame([(StructType.fromDDL(schema).json(),)], "line string"), f"{folder}/{name}.schema.json", ["line"])


def export_contracts(spark: SparkSession, folder: str) -> None:
    """The twelve contracts as JSON Schema, a file each."""
    for name in ALL:
        write_lines(spark.createDataFrame([(json_schema(name).removesuffix("\n"),)], "line string"), f"{folder}/{name}.schema.json", ["line"])


def inputs_manifest(cases: DataFrame, json: str = "json") -> DataFrame:
    """(case_id, family_id, sha256) of cases with their canonical JSON: the rows of a bundle's inputs_manifest.json."""
    return cases.select("case_id", "family_id", case_digest(F.col(json)).alias("sha256"))
