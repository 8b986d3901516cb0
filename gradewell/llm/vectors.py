"""Shared by the two vector operators: a bounded sample for a basis, and cutting rows into blocks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import stored

BLOCK = 4096  # rows of a block, about
SAMPLE = 20_000  # rows, about, that a basis and the cuts are fitted on
PAIRS = 500_000  # rows of a plan of blocks that may be sent to every task; more are joined by shuffling


def finite(col: str) -> Column:
    """Not null, not empty, every component neither null nor NaN nor infinite."""
    return F.coalesce((F.size(col) > 0) & F.forall(col, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def sampled(df: DataFrame, vec: str, rows: int) -> np.ndarray:
    """About SAMPLE of df's rows, as rows of doubles; each is taken or left on its own, so no task and no repeated row adds more than its share."""
    some = df.where(F.rand(11) < SAMPLE / rows) if rows > SAMPLE else df
    return np.array([r["v"] for r in some.select(F.col(vec).cast("array<double>").alias("v")).collect()], np.float64).reshape(-1, df.select(F.size(vec)).first()[0])


def basis(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those along which the sample has most weight first; the axes themselves where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = sample.T @ sample
    return np.linalg.eigh(square)[1][:, ::-1].copy() if np.isfinite(square).all() else np.eye(len(square))


def spread(plan: DataFrame, rows: int) -> DataFrame:
    """A plan of which blocks meet, of this many rows, to join blocks with: sent to every task if it is small."""
    return F.broadcast(plan) if rows <= PAIRS else plan.hint("merge")


def blocked(df: DataFrame, key: str, cell: str) -> tuple[DataFrame, DataFrame]:
    """df with `block` (within its cell, by hash of the key), and (cell, blocks): a cell of any size falls into blocks of about BLOCK rows."""
    cells = stored(df.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    return df.join(cells, cell).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks"), cells


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
