"""Exact top-k inner products of integer vectors: norm-sorted search.

Vectors become floor(64 * x). Candidates are cut into blocks by descending length, queries into blocks by hash; a task searches one
block of candidates for one block of queries. The longest candidates come first and give every query a score that its k-th best can't
fall below; elsewhere a block is skipped for a query if length of query times greatest length in the block stays below it. Within a task
candidates go by descending length; products of the leading SVD-rotated dimensions plus the product of the residual lengths (Cauchy and
Schwarz) bound the score, and only candidates that may still enter are computed, from the integers, exactly. The rotation is fitted on a
bounded sample; any rotation gives the same result.

Rows: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id. Vectors that are null, empty or hold null or non-finite
components, and rows with null ids, take no part; vectors of different length don't meet. A query's own row and rows repeating its id
are no candidates; a repeated query is asked once (by its first vector in array order), a repeated candidate may come up repeatedly.
Ids must be integers or cast to them; a row whose id doesn't counts as without id. Components of any finite size take part: scores are
exact, and one beyond the range of a long is the nearest long, also for ranks. Other columns are not read; an empty table gives an empty one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import scratch, stored
from gradewell.llm.vectors import BLOCK, basis, blocked, finite, matrix, sampled, spread

QUERIES = 1024  # of a block, about


LONG = 2**63 - 1


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers as doubles; what scaling makes infinite is the largest double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -np.finfo(float).max, np.finfo(float).max)


def _small(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether all products and their sums are integers below 2^53."""
    return bool(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53)


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; doubles hold them exactly up to 2^53, Python's integers beyond."""
    out = np.zeros(len(i), np.int64)
    large = np.abs(q).max(1, initial=0)[i] * np.abs(x).max(1, initial=0)[j] * q.shape[1] >= 2.0**53
    p = np.flatnonzero(~large)
    out[p] = np.einsum("ij,ij->i", q[i[p]], x[j[p]]).astype(np.int64)
    for k in np.flatnonzero(large).tolist():
        score = sum(int(a) * int(b) for a, b in zip(q[i[k]].tolist(), x[j[k]].tolist(), strict=True))
        out[k] = min(max(score, -LONG - 1), LONG)
    return out


def best(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of up to k best for each query; floor: scores that need not be kept below.
    Where squares overflow a bound is no number, and what it would bound is computed."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _best(q, q_ids, floor.copy(), x, x_ids, rot, k)


def _best(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    order = np.lexsort((x_ids, -length))
    x, x_ids, length = x[order], x_ids[order], length[order]
    q_length = np.sqrt(np.einsum("ij,ij->i", q, q))
    lead = max(1, q.shape[1] // 4)
    small = _small(q, x)
    qr, xr = q @ rot, x @ rot
    q_rest, x_rest = (np.sqrt(np.maximum(np.einsum("ij,ij->i", z[:, lead:], z[:, lead:]), 0)) for z in (qr, xr))
    held = (np.zeros(0, np.int64), np.zeros(0, x_ids.dtype), np.zeros(0, np.int64))
    for lo in range(0, len(x), 512):
        slack = 1e-9 * q_length * length[lo] + 1e-6
        live = np.flatnonzero(~(q_length * length[lo] + slack < floor))
        if not len(live):
            break  # all that follow are shorter
        hi = min(lo + 512, len(x))
        may = ~(qr[live, :lead] @ xr[lo:hi, :lead].T + np.outer(q_rest[live], x_rest[lo:hi]) + slack[live, None] < floor[live, None])
        if small and may.mean() > 0.02:  # where many are left, all products of the tile cost less than picking; exact as well
            may &= q[live] @ x[lo:hi].T >= floor[live, None]
        i, j = np.nonzero(may)
        i, j = live[i], j + lo
        other = q_ids[i] != x_ids[j]
        i, j = i[other], j[other]
        i, ids, score = np.r_[held[0], i], np.r_[held[1], x_ids[j]], np.r_[held[2], _exact(q, x, i, j)]
        order = np.lexsort((ids, ~score, i))  # ~: also of the smallest long
        i, ids, score = i[order], ids[order], score[order]
        first = np.searchsorted(i, i)
        place = np.arange(len(i)) - first
        kth = place == k - 1
        floor[i[kth]] = np.maximum(floor[i[kth]], score[kth])
        held = i[place < k], ids[place < k], score[place < k]
    return held


def _search(table: pa.Table, rot: np.ndarray, k: int, scale: float) -> pa.Table:
    query = np.asarray(table.column("query"))
    ids, x, floor = np.asarray(table.column("id")), scaled(matrix(table.column("v")), scale), np.asarray(table.column("floor"))
    i, vec, score = best(x[query], ids[query], floor[query], x[~query], ids[~query], rot, k)
    return pa.table({"query_id": ids[query][i], "vec_id": vec, "score": score})


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """is_query: a condition on the column vec_id. Ids are integers."""
    with scratch() as keep:
        return keep(stored(_top_k(vectors, is_query, k, scale, id_col, vec_col), "top-k"))


def _top_k(vectors: DataFrame, is_query: Column, k: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).try_cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = stored(src.where(finite("v") & F.col("vec_id").isNotNull()), "vectors")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("-inf"))
    found = []
    for (dim,) in sorted(tuple(r) for r in good.select(F.size("v")).distinct().collect()):
        these = good.where(F.size("v") == dim)
        rows = these.count()
        sample = scaled(sampled(these, "v", rows), scale)
        rot = basis(sample)
        # cells of descending length; their bounds from the sample
        with np.errstate(over="ignore"):
            lengths = np.sort(np.einsum("ij,ij->i", sample, sample))[::-1]
        at = np.arange(1, max(1, min(rows // BLOCK, len(lengths) // 16))) * len(lengths) // max(1, min(rows // BLOCK, len(lengths) // 16))
        bounds = np.unique(lengths[at])[::-1]
        whole = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  doubles beyond are integers
        squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + whole(x * scale) * whole(x * scale))
        cell = sum((F.when(F.col("sq") < float(b), 1).otherwise(0) for b in bounds), F.lit(0)) if len(bounds) <= 64 else F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: F.col("sq") < b))
        data = these.withColumn("sq", squares).withColumn("cell", cell.cast("long"))
        data, _ = blocked(data, "vec_id", "cell")
        data = stored(data, "data")
        tops = stored(data.groupBy("cell", "block").agg(F.max("sq").alias("top")), "tops")
        blocks_of = dict(tops.groupBy((F.col("cell") == 0).alias("first")).count().collect())
        asked = data.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "sq")).alias("x")).select("vec_id", "x.v", "x.sq")
        n = max(1, -(-asked.count() // QUERIES))
        asked = asked.withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ask")

        def run(queries: DataFrame, blocks: DataFrame, many: int, rot=rot, data=data, n=n, every=every) -> DataFrame:
            """Each block of queries against each of the blocks; queries hold the blocks that they can't skip."""
            task = F.concat_ws("-", "ask", "cell", "block").alias("task")
            mine = queries.select(task, F.lit(True).alias("query"), F.col("vec_id").alias("id"), "v", "floor")
            theirs = data.join(spread(blocks.select("cell", "block", every), many * n), ["cell", "block"]).select(task, F.lit(False).alias("query"), F.col("vec_id").alias("id"), "v", none.alias("floor"))
            return mine.union(theirs).groupBy("task").applyInArrow(lambda t: _search(t, rot, k, scale), "query_id long, vec_id long, score long")

        head = tops.where("cell = 0")
        first = asked.withColumn("floor", none).join(spread(head.select("cell", "block", every), blocks_of.get(True, 0) * n), "ask")
        first = stored(run(first, head, blocks_of.get(True, 0)), "first")
        floors = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        rest, others = tops.where("cell > 0"), blocks_of.get(False, 0)
        later = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", none)).join(spread(rest.select("cell", "block", "top", every), others * n), "ask")
        later = later.where(F.sqrt("sq") * F.sqrt("top") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        second = stored(run(later, rest, others), "second")
        found.append(first.union(second))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = found[0]
    for x in found[1:]:
        whole = whole.union(x)
    return whole.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
