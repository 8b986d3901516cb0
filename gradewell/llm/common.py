"""What several operators share: tables in the shared folder, words and their hashes, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; as a pattern for the JVM.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
#: Spark's own switch: the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only in local mode where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gradewell-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Where the tables stand that the innermost scratch() deletes.
_places: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("places", default=[])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage, survives lost executors. What was shuffled for it is let go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gradewell-{name}-{uuid.uuid4().hex}"
    _places.get().append((spark, path))  # before it is written: a job that fails leaves files as well
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote; nothing that is still to be read may depend on it."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)
        _places.get()[:] = [x for x in _places.get() if x[1] != df.stored_at]


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within go when the block ends, also by an exception. One that is handed to the function that it gives stays until the
    block around this one ends, at last until the driver does."""
    outer, own = _places.get(), []
    token = _places.set(own)

    def keep(df: DataFrame) -> DataFrame:
        place = next(x for x in own if x[1] == df.stored_at)
        own.remove(place)
        outer.append(place)
        return df

    try:
        yield keep
    finally:
        _places.reset(token)
        for spark, path in own:
            _delete(spark, path)


@atexit.register
def _at_exit() -> None:
    for spark, path in _places.get():
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)


def unused(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores before it as make it no column's of these tables."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def place_of(column: str, df: DataFrame) -> int:
    """Where a column stands, by its name as Spark resolves it."""
    return [c.lower() for c in df.columns].index(column.lower())


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z count as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # xxHash's primes
_SHORT = 32  # bytes of a word that is hashed together with others


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of a buffer: rounds of XXH64 over their bytes, eight at a time and zeros behind the last, for all pieces at
    once; XXH64 itself, one by one, for those of more than 32 bytes. No structure of the bytes survives a round."""
    size = end - begin
    out = mix(size.astype(U64) * _P5 + U64(1))
    lanes = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    some = np.flatnonzero(size <= _SHORT)
    at = 0
    while len(some):
        left = size[some] - at
        lane = lanes[begin[some] + at]
        cut = left < 8
        lane[cut] &= (U64(1) << (U64(8) * left[cut].astype(U64))) - U64(1)
        out[some] = _turned(out[some] ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        some, at = some[left > 8], at + 8
    out = (out ^ (out >> U64(33))) * _P2
    out = (out ^ (out >> U64(29))) * _P3
    out ^= out >> U64(32)
    for k in np.flatnonzero(size > _SHORT).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[begin[k] : end[k]])
    return out


class Words:
    """The words of texts that stand one after another in a buffer: hashes (A-Z lower-cased), and where each begins and ends."""

    def __init__(self, raw: np.ndarray, cuts: np.ndarray):
        """cuts: places where a word can't go on though there is no white space: where texts begin."""
        edge = np.zeros(len(raw) + 1, bool)
        edge[cuts] = True
        edge[[0, -1]] = True
        ink = ~_WHITE[raw]
        self.folded = _FOLD[raw]
        self.begin = np.flatnonzero(ink & (np.r_[True, ~ink[:-1]] | edge[:-1]))
        self.end = np.flatnonzero(ink & (np.r_[~ink[1:], True] | edge[1:])) + 1
        self.hash = hashes(self.folded, self.begin, self.end)


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, and where its texts begin and the last one ends; null counts as empty."""
    column = column.cast("large_string") if str(column.type) != "large_string" else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batches, rows: int = 500):
    """Arrow batches cut into smaller ones, so that what is built from one stays small."""
    for batch in batches:
        for lo in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(lo, rows)


def slices(offsets: np.ndarray, room: int = 2 << 20):
    """Ranges of texts of about `room` bytes, one text at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + room, side="right")) - 1)
        yield lo, hi
        lo = hi


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes; of the whole sequence if it is shorter; nothing for nothing."""
    if len(h) == 0:
        return h
    n, m = min(n, len(h)), max(1, len(h) - n + 1)
    out = np.full(m, U64(n))
    for k in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[k : k + m])
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id that has an edge to another.

    Alternating stars: each id is linked to the smallest id it knows of, first among its larger neighbours, then among its
    smaller ones, until nothing changes. Each step is an aggregation that combines before it shuffles, stored, and a join of pairs of ids
    with it. Stored, the aggregate is sent to all tasks if it is small; else both sides are plain shuffles, of which Spark splits those
    that are skewed: a star's centre doesn't meet all its edges in one task. No group is ever gathered in one place."""
    with scratch() as keep:

        def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
            e = stored(e.distinct(), "edges")
            return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

        e, state = settled(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        while state[0]:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            # an edge to a smaller neighbour that is nobody's largest neighbour would be lost without its own minimum
            large = large.union(low.where("m < a").select("a", F.col("m").alias("b")))
            down = stored(large.groupBy("a").agg(F.min("b").alias("m")), "down")
            small = large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
            last, (e, now) = e, settled(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
            discard(last, low, down)
            if now == state:
                break
            state = now
        ids = stored(e.groupBy("a").agg(F.min("b").alias("b")), "stars")
        return keep(stored(ids.select(F.col("a").alias("id"), F.col("b").alias("component")).union(ids.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), "components"))
