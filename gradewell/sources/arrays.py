"""The items of one JSON array of any size: its text is read in pieces, side by side, and cut where its items end.

Spark splits the text after closing braces. Whether a split begins inside a string, and how deep, follows from the splits before: a first
pass counts each split's quotes and brackets, a second cuts. Of items that reach over splits, the pieces are joined."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.sources.places import written

_ESCAPE = re.compile(rb"\\.", re.S)
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_BLOCK = 1 << 22
_COMMA, _OPEN, _CLOSE = map(ord, ",[]")
_PINNED = "spark.sql.files.minPartitionNum"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, int, bytes]]:
    """(path, start) of a split, its file's size, the number of pieces and their bytes: some megabytes at a time, cut between pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start, size, text = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).cast(pa.large_binary())
        ends, data = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1], text.buffers()[2]
        file = path.indices.to_numpy()
        runs = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), len(start)]
        for i, end in pairwise(runs):
            while i < end:
                j = min(end, max(i + 1, int(np.searchsorted(ends, ends[i] + _BLOCK, "right")) - 1))
                yield (path.dictionary[int(file[i])].as_py(), int(start[i])), size[i].as_py(), j - i, data[int(ends[i]) : int(ends[j])].to_pybytes()
                i = j


def _lexed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, escapes blanked, and whether each is inside a string (an opening quote is, a closing one isn't), if the first is outside."""
    chars = np.frombuffer(_ESCAPE.sub(b"__", data) if b"\\" in data else data, np.uint8)
    return chars, (np.cumsum(chars == ord('"'), dtype=np.int32) & 1).astype(bool)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: its quotes, and by how much its brackets deepen if it begins outside a string, and if inside."""
    found: dict[tuple[str, int], list[int]] = {}
    for key, size, n, data in _blocks(batches):
        one = found.setdefault(key, [size, 0, 0, 0, 0])
        chars, inside = _lexed(data)
        steps = _STEP[chars]
        deeper = [int(steps[~inside].sum(dtype=np.int64)), int(steps[inside].sum(dtype=np.int64))]
        for begins in (0, 1):
            one[3 + begins] += deeper[(one[2] + begins) % 2]
        one[1] += len(data)
        one[2] += int(np.count_nonzero(chars == ord('"')))
    rows = [(*key, *one) for key, one in found.items()]
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "size", "bytes", "quotes", "outside", "inside"), r, strict=True)) for r in rows])


def _starts(splits: list) -> dict[tuple[str, int], tuple[int, bool, int, bool]]:
    """(path, start) -> number of the split, whether it begins inside a string, how deep, and whether its last brace is none of the text.
    Each piece got a brace behind it, which the last one of a file may not have had; its size tells (3 bytes less: a byte order mark)."""
    bytes_, last = {}, {}
    for s in splits:
        bytes_[s["path"]], last[s["path"]] = bytes_.get(s["path"], 0) + s["bytes"], s["start"]
    out, inside, depth = {}, False, 0
    for k, s in enumerate(splits):
        more = last[s["path"]] == s["start"] and bytes_[s["path"]] - s["size"] in (1, -2)
        out[s["path"], s["start"]] = (k, inside, depth, more)
        depth += s["inside"] if inside else s["outside"]
        inside ^= bool(s["quotes"] % 2)
        depth += more and not inside
    return out


def _unpacked(spark: SparkSession, path: str, splits: list) -> list:
    """The splits, with the size of the text for that of a packed file. Its bytes, cut at braces and each piece with a brace behind it, are one
    more than the text's unless that ends with a brace; then they are one less than those of the text that is cut at commas in this way."""
    jvm = spark.sparkContext._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    packed = {p for p in {s["path"] for s in splits} if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(p)) is not None}
    if not packed:
        return splits
    commas = spark.read.text(path, lineSep=",").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    cut = dict(map(tuple, commas.collect()))  # a row for each file
    braces = {p: sum(s["bytes"] for s in splits if s["path"] == p) for p in packed}
    return [s.asDict() | {"size": braces[p] - (braces[p] >= cut[p])} if (p := s["path"]) in packed else s for s in splits]


def _cut(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple[int, bool, int, bool]]) -> Iterator[pa.RecordBatch]:
    """Pieces of the text, numbered within their split, with the bracket or comma that ended each; none ended the last of a split."""
    key, held, n = None, [], 0
    inside, depth = False, 0

    def rows(texts: list[bytes], marks: list[str], first: int) -> pa.RecordBatch:
        k = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([starts[key][0]] * k, pa.int32()), pa.array(range(first, first + k), pa.int64()), pa.array(marks, pa.string()), pa.array([t.decode() for t in texts], pa.string())], ["split", "k", "mark", "text"])

    def rest() -> pa.RecordBatch:
        text = b"".join(held)
        return rows([text[:-1] if starts[key][3] else text], [""], n)

    for at, _, _, data in _blocks(batches):
        if at != key:
            if key is not None:
                yield rest()
            key, held, n = at, [], 0
            _, inside, depth, _ = starts[at]
        chars, within = _lexed(data)
        outside = within == inside
        depths = depth + np.cumsum(_STEP[chars] * outside, dtype=np.int64)
        cuts = np.flatnonzero(outside & ((((chars == _COMMA) | (chars == _OPEN)) & (depths == 1)) | ((chars == _CLOSE) & (depths == 0)))).tolist()
        inside, depth = not outside[-1], int(depths[-1])
        if cuts:
            texts = [data[a + 1 : b] for a, b in pairwise([-1, *cuts])]
            texts[0] = b"".join([*held, texts[0]])
            yield rows(texts, [chr(data[c]) for c in cuts], n)
            held, n = [], n + len(cuts)
        held.append(data[cuts[-1] + 1 :] if cuts else data)
    if key is not None:
        yield rest()


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(pos, json) of the items of a JSON array: a file, or a folder of parts which make the file, by name. What is no array is refused;
    the items are not looked into. They are kept as a table, so the text is cut once."""
    kept = spark.conf.get(_PINNED, None)
    spark.conf.set(_PINNED, kept or str(spark.sparkContext.defaultParallelism))  # both passes must see the same splits
    try:
        text = spark.read.text(path, lineSep="}").select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.encode(F.concat("value", F.lit("}")), "UTF-8").alias("text")
        )
        splits = text.mapInArrow(_survey, "path string, start long, size long, bytes long, quotes long, outside long, inside long").collect()  # a row for each split
        starts = _starts(sorted(_unpacked(spark, path, splits), key=lambda s: (s["path"], s["start"])))
        pieces = written(text.mapInArrow(lambda batches: _cut(batches, starts), "split int, k long, mark string, text string"))
    finally:
        if kept is None:
            spark.conf.unset(_PINNED)
        else:
            spark.conf.set(_PINNED, kept)
    before, n = [], 0
    for r in pieces.groupBy("split").agg(F.max("k").alias("cuts")).orderBy("split").collect():
        before.append((r["split"], n))
        n += r["cuts"]
    placed = pieces.join(F.broadcast(spark.createDataFrame(before, "split int, before long")), "split").withColumn("pos", F.col("before") + F.col("k") - 1)
    edge = (F.col("k") == 0) | (F.col("mark") == "")
    joined = placed.where(edge).groupBy("pos").agg(F.max("mark").alias("mark"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda p: p["text"]), "").alias("text"))
    items = placed.where(~edge).select("pos", "mark", "text").union(joined)
    blank = F.regexp_replace("text", "[ \t\r\n\ufeff]", "") == ""
    outer = F.col("pos").isin(-1, n - 1)
    wrong = (F.col("mark") == "[").eqNullSafe(F.col("pos") != -1) | (F.col("mark") == "]").eqNullSafe(F.col("pos") != n - 2) | (outer & ~blank) | (~outer & blank & F.lit(n != 2))
    if n < 2 or not items.where(wrong).isEmpty():
        raise ValueError(f"{path}: no JSON array")
    return items.where(~outer & ~blank).select("pos", F.col("text").alias("json"))
