"""Line dedup: exact copies, and lines within one word edit of an earlier line, by a deletion-neighbourhood join.

A line is its A-Z lower-cased words. Lines with equal words are copies; the first, by (doc id, line number), stays. Of the first ones,
those of at least `min_words` words that are one inserted, deleted or replaced word away from an earlier one go as well (one edit in
five words keeps a similarity of 0.8), also where that earlier one goes itself. Blank lines stay. So a line stays exactly if no earlier
line is within the bound.

The neighbourhood of a line is every way to blank one word, and every place where a word could have gone; two lines are one edit apart
exactly if they share a variant (words before the gap, words behind it). Emitting 2n + 1 variants of every line is too much, so a coarse
round goes before: content-defined cuts (a word's own hash ends a chunk) make about three to five chunks of a line of any length, and
the coarse variants blank one chunk or two neighbours. An edit changes one chunk, or splits or joins two, so lines within the bound share
a coarse variant; a line whose cuts leave less than three chunks is cut finer too, and so is one at a length where cuts change. Only
lines that share a coarse variant emit fine ones, within the shared gap. Equal fine variants are joined to the earliest line that has
them, never to each other, and the edit distance is verified on the words.

A line's digest is BLAKE2b, 128 bits, over its words in bytes with a space between: lines of equal digests are copies. Keys of variants
sum hashes of (word, place), with places before the gap counted from the line's first word and those behind it from its last, so
that no order of words cancels out; they only say which lines to compare, and words decide.

Copies, and lines with an equal fine variant, are aggregated to the earliest before the shuffle; the aggregate is stored and rows are joined
back with it: where it is small it is sent to all tasks, else Spark splits a hot key's rows. Lines with an equal coarse variant are marked by
a window, which shuffles keys once, streams and spills; keys that a sample shows to be hot (more than 100,000 rows and a five-thousandth of
all) go another way: aggregated before the shuffle, and joined back by the table of hot keys, which is sent to all tasks and holds
5,000 at most. Both ways give the same, so the sample decides nothing but the cost. No group is gathered.

Null text stays null; empty text stays. A null id sorts first. Rows equal in id and text are one document and keep the same lines; rows that
repeat an id with other texts are documents of their own. An empty table gives an empty one. Other columns pass unread, whatever their
names but n_lines, n_dropped and has_text, which are replaced."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from gradewell.llm.common import U64, Words, discard, mix, place_of, portions, scratch, slices, stored, texts_of, unused

HOT, HOTTEST, SAMPLED = 100_000, 5_000, 1 / 64  # rows of a hot key; hot keys at most; lines that are looked at to find them
_STRIDE = U64(0x9E3779B97F4A7C15)


class Sums:
    """Sums over all prefixes and suffixes of lines that stand one after another, of hashes of (word hash, place in the line)."""

    def __init__(self, h: np.ndarray, length: np.ndarray):
        self.h, self.length = h, length
        self.begin = np.cumsum(length) - length
        self.line = np.repeat(np.arange(len(length)), length)
        rel = np.arange(len(h)) - self.begin[self.line]
        self.before = np.r_[U64(0), np.cumsum(mix(h + (rel + 1).astype(U64) * _STRIDE))]
        self.behind = np.r_[U64(0), np.cumsum(mix(h - (length[self.line] - rel).astype(U64) * _STRIDE))]

    def key(self, line: np.ndarray, i: np.ndarray, j: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Of the words before i and from j on, both counted over all lines."""
        begin, end = self.begin[line], self.begin[line] + self.length[line]
        before = mix(self.before[i] - self.before[begin] + (i - begin).astype(U64))
        return mix(mix(before + (self.behind[end] - self.behind[j])) ^ (end - j).astype(U64)) + tag.astype(U64) * _STRIDE


def step(n: np.ndarray) -> np.ndarray:
    """Words to a chunk, for lines of n words: a power of two, n / 4 to n / 2."""
    return 1 << np.maximum(np.log2(np.maximum(n, 1)).astype(np.int64) - 1, 0)


def coarse(s: Sums, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, i, j): the coarse variants of all lines and their gaps."""
    n = s.length
    parts = []
    long = np.flatnonzero(n >= min_words)
    edge = long[step(n[long]) != step(n[long] + 1)]
    work = [(long, step(n[long])), (edge, step(n[edge] + 1))]
    mixed = mix(s.h ^ U64(0xA24BAED4963EE407))
    while work:
        lines, q = work.pop()
        if not len(lines):
            continue
        size = n[lines]
        at = np.repeat(s.begin[lines] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(lines)), size)
        ends = (mixed[at] & (q[owner] - 1).astype(U64)) == 0
        ends[np.cumsum(size) - 1] = True
        stop = np.flatnonzero(ends)
        who = owner[stop]
        j = at[stop] + 1
        i = np.r_[0, j[:-1]]
        first = np.r_[True, who[1:] != who[:-1]]
        i[first] = s.begin[lines[who[first]]]
        chunks = np.bincount(who, minlength=len(lines))
        two = np.flatnonzero(who[1:] == who[:-1])
        whole = (np.r_[who, who[two]], np.r_[i, i[two]], np.r_[j, j[two + 1]])
        some = (whole[2] - whole[1]) < n[lines[whole[0]]]  # something must be left
        who, i, j = (x[some] for x in whole)
        parts.append((lines[who], s.key(lines[who], i, j, q[who]), i, j))
        finer = (chunks <= 2) & (q > 1)
        work.append((lines[finer], q[finer] // 2))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


class Lines:
    """The lines that have words, of some texts of a buffer: text and number in it (from 0), first and last byte, and sums of word hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = Words(raw, offsets[:-1])
        feeds = np.flatnonzero(raw == 10) + 1
        begins = np.sort(np.concatenate([offsets[:-1], feeds]))
        line = np.searchsorted(begins, words.begin, side="right") - 1
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        self.text = np.searchsorted(offsets, words.begin[first], side="right") - 1
        self.number = np.searchsorted(feeds, words.begin[first], side="right") - np.searchsorted(feeds, offsets[self.text], side="right")
        self.begin, self.end = words.begin[first], words.end[np.r_[first[1:], len(line)][: len(first)] - 1]
        self.sums = Sums(words.hash, np.diff(np.r_[first, len(line)]))
        self.folded = words.folded.tobytes()
        gap = np.r_[words.begin[1:] - words.end[:-1], 1]
        plain = (gap == 1) & (raw[np.minimum(words.end, len(raw) - 1)] == 32)
        plain[np.r_[first[1:], len(line)][: len(first)] - 1] = True  # what is behind a line's last word is not between words
        self.plain = np.logical_and.reduceat(plain, first) if len(first) else np.zeros(0, bool)

    def words(self, k: int) -> bytes:
        """The words of a line, lower-cased, with one space between."""
        text = self.folded[self.begin[k] : self.end[k]]
        return text if self.plain[k] else b" ".join(text.split())

    def digests(self) -> np.ndarray:
        """Two longs of each line: 128 bits of BLAKE2b."""
        text = self.folded
        parts = [text[b:e] for b, e in zip(self.begin.tolist(), self.end.tolist(), strict=True)]
        for k in np.flatnonzero(~self.plain).tolist():
            parts[k] = b" ".join(parts[k].split())
        return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


def _lines(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        raw, offsets = texts_of(batch.column(2))
        for lo, hi in slices(offsets):
            x = Lines(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            digest = x.digests()
            line, key, _, _ = coarse(x.sums, min_words)
            order = np.argsort(line, kind="stable")
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(line, minlength=len(digest)))].astype(np.int32)), pa.array(key[order].view(np.int64)))
            at = pa.array(x.text + lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(x.number.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), keys], ["doc", "rk", "line", "h1", "h2", "keys"])


def _spans(i: np.ndarray, n: np.ndarray) -> np.ndarray:
    """i, i + 1, ... of n numbers each."""
    return np.repeat(i - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _fine(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents with (line, shared coarse keys) to their lines, their bytes and fine variants within the shared gaps."""
    for batch in portions(batches):
        raw, offsets = texts_of(batch.column(2))
        wanted = batch.column(3)
        for lo, hi in slices(offsets):
            x = Lines(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            asked = wanted.slice(lo, hi - lo)
            flat = asked.flatten()
            text = np.repeat(np.arange(hi - lo), np.asarray(pc.list_value_length(asked)))
            place = lambda t, k: t << 32 | k
            there = np.append(place(x.text, x.number), -1)
            own = place(text, np.asarray(flat.field("line")).astype(np.int64))
            at = np.searchsorted(there[:-1], own)
            at[there[at] != own] = len(there)  # another text with the same hash: nothing is asked of its lines
            keys = flat.field("keys")
            want = np.asarray(keys.flatten()).view(np.uint64) ^ mix(np.repeat(at, np.asarray(pc.list_value_length(keys))).astype(U64))
            line, key, i, j = coarse(x.sums, min_words)
            hit = np.isin(key ^ mix(line.astype(U64)), want)
            line, i, j = line[hit], i[hit], j[hit]
            # a gap within a line can begin at each of its words and at its end: one place more than words
            blank, empty = _spans(i + line, j - i), _spans(i + line, j - i + 1)
            own = np.repeat(line, j - i), np.repeat(line, j - i + 1)
            blank, one = np.unique(blank, return_index=True)
            empty, two = np.unique(empty, return_index=True)
            line = np.r_[own[0][one], own[1][two]]
            start = np.r_[blank, empty] - line
            fine = x.sums.key(line, start, start + np.r_[np.ones(len(blank), np.int64), np.zeros(len(empty), np.int64)], np.zeros(len(line), np.int64))
            order = np.argsort(line, kind="stable")
            some, count = np.unique(line, return_counts=True)
            at = pa.array(x.text[some] + lo)
            text = [x.words(k) for k in some.tolist()]
            fine = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(fine[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(x.number[some].astype(np.int32)), pa.array(text, pa.binary()), fine], ["doc", "rk", "line", "words", "fine"])


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word sequences is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        same = [within_one(a.split(), b.split()) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(batch.columns[:3], batch.schema.names[:3]).filter(pa.array(same, pa.bool_()))


def _rebuild(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        texts, lost, total, left = [], [], [], []
        for text, drop in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines, gone = (text or "").split("\n"), set(drop or ())
            texts.append(text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
            total.append(len(lines) if text else 0)
            lost.append(len(gone))
            left.append(bool(texts[-1] and texts[-1].strip(" \t\n\v\f\r")))
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.bool_())], [*batch.schema.names[:-1], "n_lines", "n_dropped", "has_text"])


def dropped_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, rk, line, near): the lines that go; line counts from 0, rk is a hash of id and text, near tells a near copy from an exact one."""
    with scratch() as keep:
        return keep(stored(_dropped_lines(docs, min_words, id_col, text_col), "dropped"))


def _shared(lines: DataFrame) -> DataFrame:
    """(key, h1): the coarse variants that several different lines have, and these lines."""
    keys = lines.select("h1", F.explode("keys").alias("key"))
    counts = lines.where(F.rand(3) < SAMPLED).select(F.explode("keys").alias("key")).groupBy("key").count()
    every = lines.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    hot = stored(counts.where(F.col("count") > SAMPLED * max(HOT, every / HOTTEST)).select("key"), "hot")
    one_key = Window.partitionBy("key")  # only ids, no texts
    ends = {"h0": F.min("h1").over(one_key), "h9": F.max("h1").over(one_key)}
    if hot.isEmpty():
        return keys.withColumns(ends).where("h0 < h9").select("key", "h1").distinct()
    few = keys.join(F.broadcast(hot), "key", "left_anti").withColumns(ends).where("h0 < h9").select("key", "h1")
    many = keys.join(F.broadcast(hot), "key")
    several = many.groupBy("key").agg(F.min("h1").alias("h0"), F.max("h1").alias("h9")).where("h0 < h9").select("key")
    return few.union(many.join(F.broadcast(several), "key").select("key", "h1")).distinct()


def _dropped_lines(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    lines = stored(src.mapInArrow(lambda it: _lines(it, min_words), f"doc {kind}, rk long, line int, h1 long, h2 long, keys array<long>"), "lines")
    place = F.struct("doc", "rk", "line")
    firsts = stored(lines.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.count("*").alias("many")), "firsts")

    wanted = _shared(lines).groupBy("h1").agg(F.collect_list("key").alias("keys")).join(firsts.select("h1", "a.*"), "h1")
    wanted = wanted.groupBy(F.col("doc").alias("d"), F.col("rk").alias("k")).agg(F.collect_list(F.struct("line", "keys")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    same_doc = (F.col("rk") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d"))
    asked = src.join(wanted, same_doc).select("doc", "rk", "text", "wanted")
    near = stored(asked.mapInArrow(lambda it: _fine(it, min_words), f"doc {kind}, rk long, line int, words binary, fine array<long>"), "near")

    fine = near.select("doc", "rk", "line", F.explode("fine").alias("key"))
    earliest = stored(fine.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a < z").select("key", "a"), "earliest")
    pairs = stored(fine.join(earliest, "key").where(place > F.col("a")).select("doc", "rk", "line", "a").distinct(), "pairs")
    discard(earliest)
    # stored, so that pairs meet words in plain shuffles: a line that very many are near to is split among tasks
    texts = stored(near.select(place.alias("s"), "words").dropDuplicates(["s"]), "texts")
    checked = pairs.join(texts.select(F.col("s").alias("a"), F.col("words").alias("of_a")), "a").withColumn("s", place).join(texts, "s")
    gone = checked.select("doc", "rk", "line", "words", "of_a").mapInArrow(_verify, f"doc {kind}, rk long, line int").distinct().withColumn("near", F.lit(True))

    first = stored(firsts.where("many > 1").select("h1", "h2", "a"), "first")
    copies = lines.select("doc", "rk", "line", "h1", "h2").join(first, ["h1", "h2"]).where(place > F.col("a")).select("doc", "rk", "line", F.lit(False).alias("near"))
    # a copy of a line that goes as a near copy is behind it, so it goes as a copy
    return gone.union(copies)


def dedup_lines(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay as their text, and n_lines, n_dropped and has_text (something but white space is left);
    columns of docs with these names are replaced."""
    own = docs.drop("n_lines", "n_dropped", "has_text")
    doc, rk, lines = (unused(name, own) for name in ("doc_of", "rk_of", "lines_of"))
    drop = dropped_lines(own, min_words, id_col, text_col).groupBy(F.col("doc").alias(doc), F.col("rk").alias(rk)).agg(F.collect_set("line").alias(lines))
    joined = own.join(drop, (F.xxhash64(id_col, text_col) == F.col(rk)) & F.col(id_col).eqNullSafe(F.col(doc)), "left").select(*own.columns, lines)
    at = place_of(text_col, own)
    schema = StructType([*own.schema, StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("has_text", BooleanType())])
    return joined.mapInArrow(lambda it: _rebuild(it, at), schema)
