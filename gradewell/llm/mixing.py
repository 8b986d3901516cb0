"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source; each source's target is its weighted share of the mix, stopped at `cap` times its own size, and what is
cut off goes to the others by weight until no target is above its stop. Filled to a common level l, a target is min(l * weight, stop),
so l follows from the sources sorted by stop / weight: sums over the sources only, never over documents. A source's repetition rate is
target / size. A document is taken floor(rate) times, and once more if a hash of seed and id, as a number in [0, 1), is below the
rest of the rate. Reruns agree, and no document is taken more than ceil(rate) <= ceil(cap) times.

Null text or source: 0 words; null is a source of its own, ranked last. A source without words has target 0 and rate 0. Rows that
repeat an id are taken alike. An empty table gives an empty one. Sizes are longs, the level is one double division. A plan adds columns
and replaces those of docs that have their names; the mix has the columns of docs as they are, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import WORD, unused

#: Name of the columns that mix_plan() adds.
PLAN = ("size", "source_size", "target", "rate", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) with weight and target. Sorting the sources is the only work in one task: a row each."""
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    live = Window.partitionBy(F.lit(0))
    upto = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.where("source_size > 0")
        .withColumn("stop", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fill", F.col("stop") / F.col("weight"))
        .withColumns({"stopped": F.coalesce(F.sum("stop").over(upto), F.lit(0.0)), "passed": F.coalesce(F.sum("weight").over(upto), F.lit(0.0)), "all": F.sum("source_size").over(live) * F.lit(float(share)), "total": F.sum("weight").over(live)})
        .withColumn("level", (F.col("all") - F.col("stopped")) / (F.col("total") - F.col("passed")))
    )
    level = filled.where("level <= fill").agg(F.min(F.struct("fill", "level")).getField("level").alias("level"))
    return ranked.join(F.broadcast(level)).select(  # one row
        "source", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(float(cap))), F.col("source_size") * F.lit(float(cap)))).alias("target")
    )


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken; columns of docs with these names are replaced.

    weights: of the sources in code point order, repeated as often as needed; share: of all words, what the mix takes.
    The only shuffle is of one partial sum for each source and task."""
    own = [c for c in docs.columns if c.lower() not in PLAN]
    of = unused("source_of", docs)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).select(F.col("source").alias(of), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"{of}_0").cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return (
        docs.select(*own, size.alias("size"), *[F.col(c).alias(f"{of}_{k}") for k, c in enumerate((id_col, source_col))])
        .join(targets, F.col(f"{of}_1").eqNullSafe(F.col(of)))
        .withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop(of, f"{of}_0", f"{of}_1")
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", number: str | None = None, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken. number: a column to add, the copy's number from 1."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    plan = mix_plan(packed, id_col="id", text_col="text", source_col="source", **options).where("copies > 0")
    copies = plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select("row.*", *([F.col("copy").alias(number)] if number else []))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS stop, source_size * 2.0::DOUBLE / weight AS fill FROM r WHERE source_size > 0),
g AS (SELECT fill, ((SELECT sum(source_size) FROM f) * 1.5::DOUBLE - coalesce(sum(stop) OVER w, 0)) / ((SELECT sum(weight) FROM f) - coalesce(sum(weight) OVER w, 0)) AS level
      FROM f WINDOW w AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM g WHERE level <= fill ORDER BY fill LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(level * weight, source_size * 2.0::DOUBLE) END AS target FROM r, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
