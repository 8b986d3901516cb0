"""Quality classification: votes of the nearest labelled documents in a latent-semantic space.

A document is a vector of hashed words, of hashed word shapes (letters, digits and runs of the same sign folded) and of its style
(length, share of distinct words, share of words that repeat the one before, each in steps), weighted by 1 + log count and inverse
document frequency. A truncated SVD of the labelled vectors gives `dims` latent directions. Every document's
vector is projected there and compared by exact cosine with all labelled ones, in blocks; the `k` nearest vote, weighted by similarity.
Labelled rows are at most `sample` of each label, those whose ids hash lowest, so what is broadcast has a fixed bound (2 * sample * dims
+ features * dims floats). A vote also counts by how many labelled rows of its label each sampled one stands for.

Null, empty or wordless text has no direction: its score is the share of label 1 among labelled rows. Ties among neighbours go to the
one whose id hashes lower. Without labelled rows of both kinds the score is the share of label 1 (0.5 without any). Texts are read
whole; rows that repeat an id are scored one by one. A labelled id with several texts is learned by the text that hashes lowest, one with
several labels by the largest. Columns of docs pass unread, whatever their names but quality_score, which is replaced; an empty table
gives an empty one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradewell.llm.common import held_out, place_of, portions

WORDS, SHAPES, STYLE = 3072, 960, 64
FEATURES = WORDS + SHAPES + STYLE
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """`Heat,` Aa,   `RERE!!` A!   `12-7` 9-9   `a%%%` a%"""
    return _RUN.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Features(dict):
    """A word's two buckets, as one number; a bounded cache."""

    def __missing__(self, word: str) -> int:
        w = xxhash.xxh64_intdigest(word.lower()) % WORDS
        s = xxhash.xxh64_intdigest(shape(word)) % SHAPES
        self[word] = n = w << 10 | s
        return n

    def counts(self, text: str | None) -> np.ndarray:
        if not text or not (words := text.split()):
            return np.zeros(FEATURES, np.float32)
        n = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out = np.bincount(n >> 10, minlength=FEATURES).astype(np.float32)
        out[WORDS : WORDS + SHAPES] = np.bincount(n & 1023, minlength=SHAPES)
        steps = min(len(words).bit_length(), 20), 21 + int(10 * len(np.unique(n)) / len(n)), 40 + int(20 * (n[1:] == n[:-1]).sum() / len(n))
        out[[WORDS + SHAPES + k for k in steps]] = 1
        if len(self) > 400_000:
            self.clear()
        return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to vectors; words, shapes and style have the same length each."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    for part in (slice(0, WORDS), slice(WORDS, WORDS + SHAPES), slice(WORDS + SHAPES, FEATURES)):
        x[:, part] /= np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
    return x


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Features()
    for batch in portions(batches):
        rows = [seen.counts(t) for t in batch.column(2).to_pylist()]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for r, a in zip(rows, at, strict=True)], pa.binary())], ["h", "y", "at", "n"])


def lowest(known: DataFrame, most: int, rows: int) -> DataFrame:
    """The `most` of `rows` distinct ids that hash lowest. What can't be among them is left out before anything is sorted in one place."""
    share = min(1.0, (2 * most + 1000) / rows)  # twice as many as are wanted: fewer than wanted don't come up
    upto = F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
    return known.where(F.xxhash64("id") <= upto).orderBy(F.xxhash64("id"), "id").limit(most)


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row; of equal ones the first."""
    k = min(k, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cos, near, 1).min(1, keepdims=True)
    for r in np.flatnonzero((cos >= least).sum(1) > k):
        near[r] = np.argsort(-cos[r], kind="stable")[:k]
    return near


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, dims: int = 48, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model: idf, projection, labelled latent vectors with their votes, and the share of label 1."""
    label, id_ = F.col(label_col), F.col(id_col)
    known = labels.where(label.isin(0, 1) & id_.isNotNull() & ~held_out(id_col)).select(id_.alias("id"), label.cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    share = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    base = (share.get(1, 0) / sum(share.values())) if share else 0.5
    if len(share) < 2:
        return {"base": base}
    chosen = lowest(known.where("y = 0"), sample, share[0]).union(lowest(known.where("y = 1"), sample, share[1]))
    texts = docs.select(id_.alias("of"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("of") == F.col("id"))
    least = F.min(F.struct(F.xxhash64("text").alias("t"), "text")).getField("text").alias("text")
    found = texts.groupBy(F.xxhash64("id").alias("h"), "id", "y").agg(least).select("h", "y", "text")
    rows = sorted(found.mapInArrow(_sparse, "h long, y int, at binary, n binary").collect())  # a row for each of the sample
    if len({r["y"] for r in rows}) < 2:
        return {"base": base}
    counts = np.zeros((len(rows), FEATURES), np.float32)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.float32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    for lo in range(0, len(rows), 512):
        counts[lo : lo + 512] = weigh(counts[lo : lo + 512], idf)
    dims = min(dims, len(rows))
    q = np.random.default_rng(seed).standard_normal((FEATURES, dims + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration for the leading right singular vectors
        q = np.linalg.qr(counts.T @ (counts @ q))[0]
    v = (q @ np.linalg.svd(counts @ q, full_matrices=False)[2].T)[:, :dims]
    z = counts @ v
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    y = np.array([r["y"] for r in rows])
    vote = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    return {"base": base, "idf": idf, "v": v.astype(np.float32), "z": z.astype(np.float32), "y": y, "vote": vote}


def _score(batches: Iterator[pa.RecordBatch], at: int, m: dict, k: int) -> Iterator[pa.RecordBatch]:
    seen = Features()
    for batch in portions(batches):
        texts = batch.column(at).to_pylist()
        score = np.full(len(texts), m["base"])
        for lo in range(0, len(texts) if "z" in m else 0, 256):
            counts = np.stack([seen.counts(t) for t in texts[lo : lo + 256]])
            some = counts.any(1)
            x = weigh(counts, m["idf"]) @ m["v"]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            cos = x @ m["z"].T
            near = nearest(cos, k)
            w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(np.float64) ** 4 * m["vote"][near]
            score[lo : lo + 256] = np.where(some, (w * m["y"][near]).sum(1) / w.sum(1), m["base"])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(score, 0.0, 1.0))], [*batch.schema.names, "quality_score"])


def classify(docs: DataFrame, labels: DataFrame, k: int = 15, text_col: str = "text", model: dict | None = None, **training) -> DataFrame:
    """docs with quality_score (a column of that name is replaced); docs are not shuffled."""
    m = model or train(docs, labels, text_col=text_col, **training)
    sent = docs.sparkSession.sparkContext.broadcast(m)
    own = docs.drop("quality_score")
    at = place_of(text_col, own)
    return own.mapInArrow(lambda it: _score(it, at, sent.value, k), StructType([*own.schema, StructField("quality_score", DoubleType())]))
