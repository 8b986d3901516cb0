"""From raw documents to sampled pieces: the operators of gradewell.llm as stages of one pipeline.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents, the last one those
and `pieces`. What a stage returns is written as Parquet and read again by the next.

- language: documents without a letter, and those whose best language has less than half of the posterior, go.
- lines: repeated lines go, exact and one word edit away; the text and n_chars are what is left. A document of which nothing but white
  space is left goes, one that was empty before stays.
- near_duplicates: shingles of five words, similarity of 0.8 or more; the document with the smallest id of each group stays, once.
  Rows without an id, and of repeated ids, are compared row by row: an id with a text is a document, so different texts under one id
  that are no near duplicates all stay, each once.
- mixing: each document as often as the mix takes it.
- pieces: a sampled segmentation of each text, seeded by its doc_id and, as the stage's rows don't say which copy of a document they are,
  by a number that rows of one id and text get here: copies are segmented each in its own way.

Operators see doc_id, text and what they work on; all other columns wait in a struct, so columns of any names come out as they went in (the
last stage alone adds one, `pieces`, in the place of one of that name). Tables between stages, and all that a stage stores, are deleted as
soon as the next table stands, also if a stage fails. Nulls, empty tables and repeated rows: as the operators' docstrings say. SQL cannot express language scores, edit distances or seeded
sampling, so there is no ORACLE_SQL; tests hold the stages against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.llm import language, lines, mixing, neardup, segmentation
from gradewell.llm.common import discard, scratch, stored


def _rest(docs: DataFrame, *apart: str) -> list[str]:
    return [c for c in docs.columns if c.lower() not in apart]


def _packed(docs: DataFrame, *apart: str) -> DataFrame:
    """doc_id and the columns `apart` under these names, and all but the latter in a struct `row`."""
    return docs.select(F.struct(*[f"`{c}`" for c in _rest(docs, *apart)]).alias("row"), F.col("doc_id").alias("doc_id"), *[F.col(c).alias(c) for c in apart])


def _unpacked(rows: DataFrame, docs: DataFrame, **apart) -> DataFrame:
    """The columns of docs: those named from these expressions, the others from `row`."""
    return rows.select(*[(apart[c.lower()] if c.lower() in apart else F.col("row").getField(c)).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = language.identify(_packed(docs, "text"), language.train(docs))
    return _unpacked(known.where((F.col("lang_pred") != language.UND) & (F.col("lang_score") >= 0.5)), docs, text=F.col("text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(_packed(docs, "text")).where("has_text OR n_dropped = 0")
    return _unpacked(left, docs, text=F.col("text"), n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    odd = stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id", F.lit(2).alias("rank")), "odd")
    if odd.isEmpty():
        found = neardup.near_duplicates(rows).where("NOT kept").select("doc_id")
        return rows.join(found, "doc_id", "left_anti").select("row.*")
    # an id and a text are a document; of a group, one whose id is its own stays before one without an id, and that before one whose id is repeated
    named = rows.where("doc_id IS NOT NULL").join(odd, "doc_id", "left").select(*rows.columns, F.coalesce("rank", F.lit(0)).alias("rank"))
    ranked = named.union(rows.where("doc_id IS NULL").withColumn("rank", F.lit(1)))
    id_ = F.coalesce("doc_id", F.lit("0").cast(docs.schema["doc_id"].dataType)).alias("id")
    keyed = ranked.select("row", "rank", F.struct("rank", id_, F.xxhash64("text").alias("hash")).alias("key"), "text")
    found = neardup.near_duplicates(keyed, id_col="key").where("NOT kept").select(F.col("doc_id").alias("key")).distinct()
    left = keyed.join(found, "key", "left_anti")
    # one row for each id and text: the least by its columns
    one = left.where("rank > 0").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.where("rank = 0").select("row.*").union(one.select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _packed(docs, "text").withColumn("hash", F.xxhash64("text"))
    same = Window.partitionBy("doc_id", "hash").orderBy(F.xxhash64("row"), "text")
    coded = segmentation.encode(rows.withColumn("copy", F.row_number().over(same)), copy_col="copy")
    own = docs.select(*[c for c in docs.columns if c.lower() != "pieces"])
    return coded.select(*[(F.col("text") if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in own.columns], "pieces")


STAGES = [("language", language_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("pieces", pieces_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
