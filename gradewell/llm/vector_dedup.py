"""Near-duplicate embeddings: PCA-ordered tiled comparison, exact.

Equal vectors become one class with a multiplicity. Unit vectors are rotated so that their leading dimensions carry most weight; the
rotation is fitted on a bounded sample, any rotation gives the same result. The space is cut into cells along leading dimensions, and
cells whose boxes lie farther apart than the threshold allows are never compared; the rest fall into blocks of about 4096 rows, and a
task compares two blocks. There, products of the first dimensions are accumulated, and where these plus the product of the suffix norms
cannot reach the threshold the pair is dropped; what is left is accumulated further, and at the end computed from the given components in
double precision. A task returns, for each row, how many vectors it is linked with, and a spanning forest of its links: never all pairs.

Rows: vec_id, n_links, component_id, kept. Vectors that are null, empty, zero or hold null or non-finite components link with nothing
(n_links 0, component their own id), nor do rows with null ids; vectors of different length are not compared. Every row counts as a
vector; rows that repeat an id share the smallest component. Other columns are not read; an empty table gives an empty one.

Equal vectors are brought back to their rows by a join with the stored table of classes: that is sent to all tasks if it is small, else Spark
splits the rows of a vector that many share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import components, scratch, stored
from gradewell.llm.vectors import BLOCK, basis, blocked, finite, matrix, sampled, spread

BOX = 8  # leading dimensions that cells are cut along
CELLS = 1024  # at most


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cut(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A balanced tree of median cuts, node k over 2k+1 and 2k+2: (dimension, value), each along the widest of the leading dimensions."""
    tree: list[tuple[int, float]] = []
    level = [sample]
    while len(level) < cells and min(map(len, level)) >= 16:
        below = []
        for x in level:
            dim = int(x[:, :BOX].std(0).argmax())
            at = float(np.median(x[:, dim]))
            tree.append((dim, at))
            below += [x[x[:, dim] <= at], x[x[:, dim] > at]]
        level = below
    return tree


def cell_of(tree: list[tuple[int, float]], y: np.ndarray) -> np.ndarray:
    k = np.zeros(len(y), np.int64)
    dims, at = np.array([d for d, _ in tree] or [0]), np.array([v for _, v in tree] or [0.0])
    for _ in range((len(tree) + 1).bit_length() - 1):
        k = 2 * k + 1 + (y[np.arange(len(y)), dims[k]] > at[k])
    return k


def links_of(x: np.ndarray, y: np.ndarray, rot: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with a cosine of at least threshold; of same rows each pair once."""
    d = x.shape[1]
    steps = sorted({min(d, max(1, d // 4)), min(d, max(1, d // 2)), d})
    xr, yr = x @ rot, y @ rot
    tail = lambda z, k: np.sqrt(np.maximum(np.einsum("ij,ij->i", z[:, k:], z[:, k:]), 0))
    least = threshold - 1e-9
    found = []
    for lo in range(0, len(x), 1024):
        a = xr[lo : lo + 1024]
        bound = a[:, : steps[0]] @ yr[:, : steps[0]].T
        bound += np.outer(tail(a, steps[0]), tail(yr, steps[0]))
        i, j = np.nonzero(bound >= least)
        if same:
            i, j = i[j > i + lo], j[j > i + lo]
        done = np.zeros(0)
        for part in range(0, len(i), 1 << 18):
            p, q = i[part : part + (1 << 18)], j[part : part + (1 << 18)]
            done = np.einsum("ij,ij->i", a[p, : steps[0]], yr[q, : steps[0]])
            for k, upto in zip(steps, steps[1:], strict=False):
                done = done + np.einsum("ij,ij->i", a[p, k:upto], yr[q, k:upto])
                on = done + tail(a, upto)[p] * tail(yr, upto)[q] >= least
                p, q, done = p[on], q[on], done[on]
            on = np.einsum("ij,ij->i", x[lo + p], y[q]) >= threshold
            found.append((lo + p[on], q[on]))
    return tuple(np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable over the pairs, for each of n."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def comparing(rot: np.ndarray, threshold: float):
    return lambda table: _compare(table, rot, threshold)


def _compare(table: pa.Table, rot: np.ndarray, threshold: float) -> pa.Table:
    """A pair of blocks to (a, b, n): a is linked with n vectors, and of one component with b."""
    side = np.asarray(table.column("side"))
    ids, many, vec = table.column("id").combine_chunks(), np.asarray(table.column("many")), units(matrix(table.column("v")))
    order = np.lexsort((np.asarray(ids), side))
    side, many, vec, ids = side[order], many[order], vec[order], ids.take(pa.array(order))
    n, same = int((side == 0).sum()), not (side == 1).any()
    i, j = links_of(vec[:n], vec if same else vec[n:], rot, threshold, same)
    j = j if same else j + n
    count = np.bincount(i, many[j], len(vec)) + np.bincount(j, many[i], len(vec))
    low = forest(len(vec), i, j)
    some = np.flatnonzero(count > 0)
    return pa.table({"a": ids.take(pa.array(some)), "b": ids.take(pa.array(low[some])), "n": pa.array(count[some].astype(np.int64))})


def vector_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    with scratch() as keep:
        return keep(stored(_vector_duplicates(vectors, threshold, id_col, vec_col), "vector-duplicates"))


def _vector_duplicates(vectors: DataFrame, threshold: float, id_col: str, vec_col: str) -> DataFrame:
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    good = src.where(finite("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    classes = stored(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("many")).select("id", "many", "v"), "classes")
    edges, counts = [], []
    for dim, rows in sorted(tuple(r) for r in classes.groupBy(F.size("v")).count().collect()):
        these = classes.where(F.size("v") == dim)
        sample = units(sampled(these, "v", rows))
        rot = basis(sample)
        tree = cut(sample @ rot, min(CELLS, 2 ** math.ceil(math.log2(max(1, rows / BLOCK)))))

        def placed(batches, rot=rot, tree=tree):
            for b in batches:
                y = units(matrix(pa.chunked_array([b.column(2)]))) @ rot if b.num_rows else np.zeros((0, rot.shape[1]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(tree, y)), pa.array(list(y[:, :BOX]), pa.list_(pa.float64()))], [*b.schema.names, "cell", "y"])

        cells = these.mapInArrow(placed, f"id {kind}, many long, v {classes.schema['v'].dataType.simpleString()}, cell long, y array<double>")
        cells, sizes = blocked(stored(cells, "cells"), "id", "cell")
        wide = min(BOX, dim)
        boxes = cells.groupBy("cell").agg(*[f(F.col("y")[k]).alias(f"{n}{k}") for k in range(wide) for n, f in (("lo", F.min), ("hi", F.max))]).join(sizes, "cell").orderBy("cell").collect()  # at most CELLS rows
        lo, hi = (np.array([[r[f"{n}{k}"] for k in range(wide)] for r in boxes]) for n in ("lo", "hi"))
        near = []
        for k, r in enumerate(boxes):
            gap = np.maximum(np.maximum(lo[k] - hi[k:], lo[k:] - hi[k]), 0)
            for q in np.flatnonzero((gap**2).sum(1) <= 2 - 2 * threshold + 1e-9) + k:
                near.append((r["cell"], boxes[q]["cell"], r["blocks"], boxes[q]["blocks"]))
        pairs = (
            spark.createDataFrame(near, "c1 long, c2 long, n1 int, n2 int")
            .select("c1", "c2", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)).alias("b1"), "n2")
            .select("c1", "c2", "b1", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("b2"))
            .where("c1 < c2 OR b1 <= b2")
            .withColumn("pair", F.concat_ws("-", "c1", "b1", "c2", "b2"))
        )
        many = sum(n1 * n2 for _, _, n1, n2 in near)
        ends = pairs.select("pair", F.lit(0).alias("side"), F.col("c1").alias("cell"), F.col("b1").alias("block")).union(pairs.where("c1 != c2 OR b1 != b2").select("pair", F.lit(1), "c2", "b2"))
        dealt = cells.select("id", "many", "v", "cell", "block").join(spread(ends, 2 * many), ["cell", "block"]).select("pair", "side", "id", "many", "v")
        out = stored(dealt.groupBy("pair").applyInArrow(comparing(rot, threshold), f"a {kind}, b {kind}, n long"), "links")
        edges.append(out.where("a != b").select("a", "b"))
        counts.append(out.groupBy("a").agg(F.sum("n").alias("n")))
    if edges:
        whole, number = edges[0], counts[0]
        for e, c in zip(edges[1:], counts[1:], strict=True):
            whole, number = whole.union(e), number.union(c)
        found = components(whole)
    else:
        found = spark.createDataFrame([], f"id {kind}, component {kind}")
        number = spark.createDataFrame([], f"a {kind}, n long")
    found = found.groupBy("id").agg(F.min("component").alias("component"))
    by_class = classes.join(number.withColumnRenamed("a", "id"), "id", "left").join(found, "id", "left")
    by_class = stored(by_class.select(F.col("v").alias("cv"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("component", "id").alias("c")), "by-class")
    linked = good.join(by_class, F.col("v") == F.col("cv")).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    # rows of one id share the smallest component
    rest = src.where(~(finite("v") & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()) | F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
