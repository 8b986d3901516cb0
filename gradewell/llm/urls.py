"""URL filter: rules first; for what they don't decide, naive Bayes over the words of host and path.

Hosts are written without spaces, so a host's labels are split by a unigram Viterbi over the words of all pages (their visible text); path
parts are split alike. The urls that a rule decides are the labelled ones: of each, what the rule itself matched (the end of the host, the
start of the path) is taken away, the words of the rest are counted for the rule's verdict, and a multinomial naive Bayes with add-one
smoothing, and priors by the verdicts' shares of urls, is learned from these counts. It scores the words of the urls without a rule. Words
fall into 2^18 hashed buckets, so the model has a fixed bound whatever the number of words.

The unigram model is of all words, however rare or long. Splitting a part asks only for words that occur in it, so words are joined with the
runs of letters of the distinct parts, by 64-bit hashes (equal hashes of other words only add words that are then not found). Words that
occur in most pages' parts, at most `vocabulary`, are sent to every worker (a histogram of powers of two says how many pages that takes);
the others, each in few pages, are joined with the parts and by these with the urls that need them. Where there are no others, pages
are not shuffled.

A null url, or one without `://`, has empty host and path, no rule, and the verdict of no words: that of the greater prior, allow if equal.
Without any url that a rule decides, all is allowed. Ties between rules of one length go to the one first in code point order. Rows that
repeat a page_id are learned from and judged one by one. Other columns are not read, whatever their names; an empty table gives an empty one."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import U64, mix, portions, scratch, stored

#: (pattern, verdict); a pattern is a host, then a path from its first `/`.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BUCKETS = 1 << 18  # of words, for the naive Bayes
_TAG = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_AZ = {c: c + 32 for c in range(65, 91)}
_BASE = 0x9E3779B97F4A7C15


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    rest = (url or "").partition("://")[2]
    k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    return rest[:k].translate(_AZ), re.split("[?#]", rest[k:], maxsplit=1)[0]


def parts_of(host: str, path: str) -> list[str]:
    """The runs of letters that are split into words."""
    return _WORD.findall(host) + _WORD.findall(path.lower())


class Rules:
    def __init__(self, rules):
        self.of: dict[str, list] = {}
        for pattern, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
            host, slash, path = pattern.partition("/")
            self.of.setdefault(host, []).append((slash + path, pattern, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        found, at = [], host
        while True:
            found += [(-len(p), p, v) for start, p, v in self.of.get(at, ()) if path.startswith(start)]
            _, dot, at = at.partition(".")
            if not dot:
                break
        return min(found)[1:] if found else (None, None)


def unmatched(host: str, path: str, rule: str) -> tuple[str, str]:
    """Host and path without what the rule matched."""
    end, slash, start = rule.partition("/")
    return host[: len(host) - len(end)], path[len(slash + start) :]


class Words:
    """The unigram model."""

    def __init__(self, counts: dict[str, int], n_words: int | None = None, n_distinct: int | None = None):
        """counts may be of some words only; then n_words and n_distinct are over all."""
        self.all = (sum(counts.values()) if n_words is None else n_words) + (len(counts) if n_distinct is None else n_distinct) + 1
        self.logp = {w: self.known(n) for w, n in counts.items()}
        self.sizes = sorted({len(w) for w in self.logp}, reverse=True)
        self.unknown = math.log(1 / self.all)
        self.cache: dict[str, list[str]] = {}

    def known(self, n: int) -> float:
        return math.log((n + 1) / self.all)

    def split(self, name: str, more: dict[str, float] | None = None) -> list[str]:
        """The likeliest words of a run of letters, of any length; unknown ones cost more with each letter. more: words of name that the model lacks."""
        if name in self.cache:
            return self.cache[name]
        more = more or {}
        sizes = sorted({*self.sizes, *map(len, more)}, reverse=True) if more else self.sizes
        best, cut, start = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1), 0
        for j in range(1, len(name) + 1):
            if best[j - 1] + 2.3 * (j - 1) > best[start] + 2.3 * start:
                start = j - 1  # where the best unknown word begins; a known one is never worse than the same as unknown
            best[j], cut[j] = best[start] + self.unknown - 2.3 * (j - start), start
            for i in (j - size for size in sizes if size <= j):
                w = self.logp.get(name[i:j], more.get(name[i:j]))
                if w is not None and best[i] + w > best[j]:
                    best[j], cut[j] = best[i] + w, i
        out, j = [], len(name)
        while j:
            out.append(name[cut[j] : j])
            j = cut[j]
        if len(self.cache) > 100_000:
            self.cache.clear()
        self.cache[name] = out = out[::-1]
        return out

    def tokens(self, host: str, path: str, more: dict[str, float] | None = None) -> list[str]:
        return [w for part in parts_of(host, path) for w in self.split(part, more)]


class Buckets(dict):
    """A word's bucket; a bounded cache."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = k = xxhash.xxh64_intdigest(word) % BUCKETS
        return k


class Bayes:
    """Log odds of `block`: prior, and a weight for each bucket."""

    def __init__(self, counts: np.ndarray, urls: np.ndarray):
        """counts: verdicts (allow, block) by buckets; urls: of each verdict."""
        seen = int((counts.sum(0) > 0).sum())
        total = counts.sum(1, keepdims=True) + max(seen, 1)
        self.weight = np.log((counts[1] + 1) / total[1]) - np.log((counts[0] + 1) / total[0])
        self.prior = math.log((urls[1] + 1) / (urls[0] + 1))
        if not urls.any():
            self.weight[:] = 0.0

    def odds(self, words: list[str], buckets: dict[str, int]) -> float:
        return self.prior + float(sum(self.weight[buckets[w]] for w in words))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return batch

    for batch in batches:
        for html in batch.column(0).to_pylist():
            if html:
                seen.update(_WORD.findall(_TAG.sub(" ", html).lower()))
            if len(seen) > 200_000:
                yield out()
    yield out()


class _Runs:
    """Hashes of runs of letters within texts that stand one after another: polynomials in a base, by prefix sums."""

    def __init__(self, texts: list[str]):
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        power, self.inverse = (np.r_[U64(1), np.cumprod(np.full(len(letters), U64(pow(_BASE, e, 2**64))))] for e in (1, -1))
        self.total = np.r_[U64(0), np.cumsum(mix(letters + U64(1)) * power[:-1])]
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def hash(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.total[at + size] - self.total[at]) * self.inverse[at] + np.asarray(size).astype(np.uint64)).view(np.int64)


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = _Runs(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs.hash(runs.begin, runs.sizes)), pa.array(runs.sizes)], ["word", "n", "hash", "size"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter(part for url in batch.column(0).to_pylist() for part in parts_of(*split_url(url)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["part", "n"])


def _number(part: str) -> int:
    """A part in 64 bits: what is joined by it need not carry its letters. Parts of equal numbers only share words that are then not found."""
    return xxhash.xxh64_intdigest(part) - (1 << 63)


def _url_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, url) to (key, part), parts by their numbers."""
    for batch in batches:
        rows = [(key, part) for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for part in {_number(p) for p in parts_of(*split_url(url))}]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["key", "part"])


def _runs(batches: Iterator[pa.RecordBatch], sizes: list[int], named: bool) -> Iterator[pa.RecordBatch]:
    """Runs of letters that may be words: (hash, n), in how many pages' parts; or (part, hash), a part by its number."""
    for batch in portions(batches, 5000):
        texts = batch.column(0).to_pylist()
        runs, numbers = _Runs(texts), np.fromiter(map(_number, texts), np.int64, len(texts))
        n, owner = np.asarray(batch.column(1)), np.repeat(np.arange(batch.num_rows), runs.sizes)
        left = np.repeat(runs.begin + runs.sizes, runs.sizes) - np.arange(len(owner))
        for size in sizes:
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            if named:
                yield pa.RecordBatch.from_arrays([pa.array(numbers[owner[at]]), pa.array(runs.hash(at, size))], ["part", "hash"])
            else:
                found, of = np.unique(runs.hash(at, size), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(of, n[owner[at]]).astype(np.int64))], ["hash", "n"])


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """word, n, hash, size: all words of two letters or more of all pages."""
    counts = pages.select(html_col).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where("length(word) > 1").mapInArrow(_hash_words, "word string, n long, hash long, size long")


def _ruled(batches: Iterator[pa.RecordBatch], words: Words, fixed: Rules):
    """Of each batch: ids, and for each row (host, path, rule, verdict, words that the model lacks)."""
    for batch in batches:
        rows = []
        own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for url, lacking in zip(batch.column(1).to_pylist(), own, strict=True):
            host, path = split_url(url)
            rule, verdict = fixed.match(host, path) if host else (None, None)
            rows.append((host, path, rule, verdict, {x["word"]: words.known(x["n"]) for x in lacking or ()}))
        yield batch.column(0), rows


def _learn(batches: Iterator[pa.RecordBatch], unigrams: tuple, rules) -> Iterator[pa.RecordBatch]:
    """(verdict, bucket, n) of the urls that a rule decides; bucket -1 counts the urls."""
    words, buckets = Words(*unigrams), Buckets()
    n = np.zeros((2, BUCKETS + 1), np.int64)
    for _, rows in _ruled(batches, words, Rules(rules)):
        for host, path, rule, verdict, more in rows:
            if rule is not None:
                of = n[int(verdict == "block")]
                of[-1] += 1
                for w in words.tokens(*unmatched(host, path, rule), more):
                    of[buckets[w]] += 1
    which, at = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(n[which, at])], ["verdict", "bucket", "n"])


def _judge(batches: Iterator[pa.RecordBatch], unigrams: tuple, bayes: Bayes, rules) -> Iterator[pa.RecordBatch]:
    words, buckets = Words(*unigrams), Buckets()
    for ids, found in _ruled(batches, words, Rules(rules)):
        rows = []
        for host, path, rule, verdict, more in found:
            odds = bayes.odds(words.tokens(host, path, more), buckets)
            rows.append((host, path, rule, verdict or ("block" if odds > 0 else "allow"), odds))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.float64())], ["page_id", "host", "path", "rule", "verdict", "block_odds"])


def _with_words(pages: DataFrame, rows: DataFrame, html_col: str, vocabulary: int) -> tuple[DataFrame, tuple]:
    """rows, with `own` where a url needs words that are not sent; and what is sent: counts, and the numbers of words and of distinct ones."""
    words = stored(word_counts(pages, html_col), "words")
    parts = stored(rows.select("url").mapInArrow(_parts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")), "parts")
    n_words, n_distinct, sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.sort_array(F.collect_set("size"))).first()
    runs = parts.mapInArrow(lambda it: _runs(it, sizes, False), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("pages"))
    power = F.floor(F.log2("pages")).cast("int").alias("power")
    found = stored(words.join(runs, "hash").select("word", "n", "hash", power), "found")
    least, sent = 64, 0
    for k, many in sorted(map(tuple, found.groupBy("power").count().collect()), reverse=True):  # at most 64 rows
        sent += many
        if sent > vocabulary:
            break
        least = k
    counts = {r["word"]: r["n"] for r in found.where(F.col("power") >= least).select("word", "n").collect()}  # at most vocabulary
    others = found.where(F.col("power") < least)
    if not others.isEmpty():
        of_part = parts.mapInArrow(lambda it: _runs(it, sizes, True), "part long, hash long").join(others, "hash").groupBy("part").agg(F.collect_set(F.struct("word", "n")).alias("own"))
        of_part = stored(of_part, "of-part")
        key = F.xxhash64("url").alias("key")  # equal keys of other urls only share words, as parts do
        of_url = rows.where("url IS NOT NULL").select(key, "url").distinct().mapInArrow(_url_parts, "key long, part long").join(of_part, "part").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("own"))
        own = stored(of_url, "own")
        known = rows.where("url IS NOT NULL").select("*", key).join(own, "key", "left").select("page_id", "url", "own")
        rows = known.union(rows.where("url IS NULL").withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    return rows, (counts, n_words, n_distinct)


def judge(pages: DataFrame, rules=RULES, counts: dict[str, int] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", vocabulary: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict, block_odds: a row for each page. vocabulary bounds the words sent to every worker, not the model."""
    kind, context = pages.schema[id_col].dataType.simpleString(), pages.sparkSession.sparkContext
    with scratch() as keep:
        rows, unigrams = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), (counts, None, None)
        if counts is None:
            rows, unigrams = _with_words(pages, rows, html_col, vocabulary)
        sent = context.broadcast(unigrams)
        learned = rows.mapInArrow(lambda it: _learn(it, sent.value, rules), "verdict int, bucket int, n long").groupBy("verdict", "bucket").agg(F.sum("n").alias("n"))
        table = learned.toArrow()  # at most two rows a bucket
        n = np.zeros((2, BUCKETS + 1), np.int64)
        n[np.asarray(table.column("verdict")), np.asarray(table.column("bucket"))] = np.asarray(table.column("n"))
        bayes = context.broadcast(Bayes(n[:, :-1], n[:, -1]))
        judged = rows.mapInArrow(lambda it: _judge(it, sent.value, bayes.value, rules), f"page_id {kind}, host string, path string, rule string, verdict string, block_odds double")
        out = keep(stored(judged, "judged"))
        for model in (sent, bayes):
            model.destroy()
        return out
