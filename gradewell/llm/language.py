"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; whatever is not a letter counts as one kind of space. Bigrams and trigrams go to hashed buckets. The model is
a matrix of log probabilities, languages by buckets (bounded: languages * 2^15 * 4 bytes), sent to every worker. It is learned from all
labelled rows that are not held out: tasks count, only counts are shuffled; priors are the languages' shares of these rows. Texts are
scored whole, a batch at a time: its n-grams stand one after another as a sparse matrix of rows by buckets, whose product with the
model is one gather and one sum by rows.

Null text, and text without a letter: `und`, score 0. The language with the greatest posterior is predicted; the score is its share of
the posterior, with evidence discounted to the square root of the n-grams (they are not independent). Ties go to the language first in
code point order. Rows that repeat an id are learned and scored one by one. Without a labelled row every text is `und`. Columns of docs pass
unread, whatever their names but lang_pred and lang_score, which are replaced; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gradewell.llm.common import held_out, place_of, portions

BITS = 15
UND = "und"
FLAT = 1 << 18  # n-grams scored at once, about; of one longer text as many at a time


class Model(tuple):
    """(languages, log probabilities as buckets by languages), and the languages' log priors; even ones if none are given."""

    def __new__(cls, langs: list[str], logp: np.ndarray, prior: np.ndarray | None = None):
        self = super().__new__(cls, (langs, logp))
        self.prior = np.zeros(len(langs)) if prior is None else prior
        return self

    def __getnewargs__(self):
        return (*self, self.prior)



@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Buckets of a text's bigrams and trigrams; none if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint32)
    c = np.where(letter, c, np.uint32(32))
    c = np.r_[np.uint32(32), c, np.uint32(32)] * np.uint32(0x9E3779B1)
    two = (c[:-1] ^ (c[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c[2:]
    h = np.concatenate([two, three])
    return ((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def out():
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(max(1, len(some)), np.int64))), pa.array(some if len(some) else np.zeros(1, np.int64)), pa.array(counts[some] if len(some) else np.zeros(1, np.int64))], ["lang", "bucket", "n"])
        total.clear()

    for batch in portions(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in total and len(total) >= 128:
                yield from out()
            at = total.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            at += np.bincount(grams(text), minlength=(1 << BITS) + 1)
            at[-1] += 1  # rows
    yield from out()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Languages, log probabilities and log priors, from all rows that have a language and are not held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counted = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages * buckets rows at most
    langs = sorted(table.column("lang").unique().to_pylist())
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    c = np.zeros(((1 << BITS) + 1, len(langs)))
    at = np.asarray(pc.index_in(table.column("lang"), pa.array(langs, table.schema.field("lang").type)))
    c[np.asarray(table.column("bucket")), at] += np.asarray(table.column("n"))
    rows, c = c[-1], c[:-1] + 0.5
    return Model(langs, np.log(c / c.sum(0)).astype(np.float32), np.log(rows / rows.sum()))


def posterior(texts: list[str | None], langs: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the language's number (-1: undetermined) and its share."""
    best, share = np.full(len(texts), -1), np.zeros(len(texts))
    rows: list[int] = []
    held: list[np.ndarray] = []

    def settle() -> None:
        if not rows:
            return
        n = np.array([len(g) for g in held])
        total = np.add.reduceat(np.take(logp, np.concatenate(held), axis=0), np.cumsum(n) - n, axis=0, dtype=np.float64) if n.max() <= FLAT else np.stack(
            [sum(np.take(logp, g[k : k + FLAT], axis=0).sum(0, dtype=np.float64) for k in range(0, len(g), FLAT)) for g in held])
        s = total + prior
        k = s.argmax(1)
        p = np.exp((s - s.max(1, keepdims=True)) / np.sqrt(n)[:, None])
        best[rows], share[rows] = k, p[np.arange(len(k)), k] / p.sum(1)
        rows.clear()
        held.clear()

    room = 0
    for at, text in enumerate(texts if langs else ()):
        g = grams(text) if text else ()
        if len(g) == 0:
            continue
        if room + len(g) > FLAT:
            settle()
            room = 0
        rows.append(at)
        held.append(g)
        room += len(g)
    settle()
    return best, share


def _score(batches: Iterator[pa.RecordBatch], at: int, langs: list[str], logp: np.ndarray, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = pa.array([*langs, UND], pa.string())
    for batch in portions(batches):
        best, share = posterior(batch.column(at).to_pylist(), langs, logp, prior)
        pred = names.take(pa.array(np.where(best < 0, len(langs), best)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pred, pa.array(share)], [*batch.schema.names, "lang_pred", "lang_score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, text_col: str = "text", **training) -> DataFrame:
    """docs with lang_pred and lang_score (columns of these names are replaced); no shuffle of docs. Without a model, one is trained on docs."""
    model = model or train(docs, text_col=text_col, **training)
    model = model if isinstance(model, Model) else Model(*model)
    sent = docs.sparkSession.sparkContext.broadcast((*model, model.prior))
    own = docs.drop("lang_pred", "lang_score")
    at = place_of(text_col, own)
    return own.mapInArrow(lambda it: _score(it, at, *sent.value), StructType([*own.schema, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))
