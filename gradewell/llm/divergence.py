"""How far the words of a language's sources lie apart, by mergeable radix tries.

A term is a run of letters (A-Z, a-z and all beyond ASCII), A-Z lower-cased. Within a language, terms of at least `min_docs` documents are
kept. Each source of the language, and the language itself, gives each kept term p = 1 + floor(scale * (count + 1) / (N + V)): count
occurrences there, N all of kept terms there, V kept terms. Two of them differ by f(p, q) = floor((p - q)^2 / q) in a term.

Part `pair`: for each source, every other one of its language, by the sum of f over all kept terms. Part `term`: for each source, the terms
that occur in it more than in the language (p > q), by f against the language, the first `top` of them. Ranks are from 1, by value
descending, then by the item's bytes.

Tries. Each task counts the terms of its texts in a byte trie, each leaf with counters (occurrences, documents) for each source it occurs
in. A trie is written in preorder: a leaf is the number of bytes that it shares with the one before it and the edge that it adds. Tries are
cut at the same places by prefix; the pieces of a range from all tasks are merged in one, so a leaf is shuffled once for each task, however
frequent the term. The cuts are quantiles of a bounded sample of terms and decide only what is merged where. What is left of a range in a
language is written to a table; totals are sums over that table's rows. A last traversal, leaves in UTF-8 order, streams partial sums of
pairs and, for each source, the range's first `top` terms, where the order of leaves breaks ties.

All arithmetic is in whole numbers, exact while N + V stays below 9e15. Null texts, languages and sources count as ''. Every row is a
document of its own, so repeated ids count as often as they are there. A source without terms, or a language without kept ones, has its
pairs too (0 if V = 0). Empty tables give empty ones. Texts and terms are of any length; only the three columns are read."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import _FOLD, hashes, scratch, slices, stored, texts_of

#: A term, as a pattern for the JVM; as bytes, what is in _INK.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_INK = np.zeros(256, bool)
_INK[65:91] = _INK[97:123] = _INK[128:] = True

SAMPLE = 2000  # documents, about, whose terms the cuts are taken from
SAMPLED = 20_000  # of these terms at most
RANGES = 256  # at least
RANGE = 128 << 20  # bytes of text for a range, about
LEAVES = 400_000  # of a task's trie, before it is handed on
_BLOCK = 4096  # terms of a traversal at once


def _shared(a: bytes, b: bytes) -> int:
    """Leading bytes that are the same."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


class Trie:
    """Leaves in byte order, and counters: leaf, group, occurrences, documents, sorted by leaf and group."""

    def __init__(self, terms: list[bytes], leaf: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray):
        self.terms, self.leaf, self.group, self.count, self.docs = terms, leaf, group, count, docs

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """Leaves with the same path become one, their counters are added."""
        if len(tries) == 1:
            return tries[0]
        terms = sorted(set().union(*[t.terms for t in tries]))
        at = dict(zip(terms, range(len(terms)), strict=True))
        leaf = np.concatenate([np.fromiter(map(at.__getitem__, t.terms), np.int64, len(t.terms))[t.leaf] for t in tries])
        group, count, docs = (np.concatenate([getattr(t, c) for t in tries]) for c in ("group", "count", "docs"))
        return cls(terms, *_summed(leaf, group, count, docs))

    def piece(self, lo: int, hi: int) -> Trie:
        """The leaves lo .. hi - 1."""
        a, b = np.searchsorted(self.leaf, (lo, hi))
        return Trie(self.terms[lo:hi], self.leaf[a:b] - lo, self.group[a:b], self.count[a:b], self.docs[a:b])

    def chosen(self, leaves: np.ndarray, counters: np.ndarray) -> Trie:
        """These leaves, of the counters those that are chosen."""
        keep = leaves[self.leaf] & counters
        return Trie([self.terms[k] for k in np.flatnonzero(leaves)], (np.cumsum(leaves) - 1)[self.leaf[keep]], self.group[keep], self.count[keep], self.docs[keep])

    def dump(self) -> bytes:
        """Preorder: for each leaf the bytes shared with the one before, and the edge."""
        shared = [_shared(a, b) for a, b in pairwise([b"", *self.terms])]
        edges = [t[k:] for t, k in zip(self.terms, shared, strict=True)]
        head = np.array([len(self.terms), len(self.leaf)], np.int64)
        numbers = [head, self.leaf, self.group, self.count, self.docs, np.array(shared, np.int64), np.array([len(e) for e in edges], np.int64)]
        return b"".join([*(np.asarray(x, np.int64).tobytes() for x in numbers), *edges])

    @classmethod
    def load(cls, body: bytes) -> Trie:
        n, m = np.frombuffer(body, np.int64, 2)
        leaf, group, count, docs = np.frombuffer(body, np.int64, 4 * m, 16).reshape(4, m)
        shared, size = np.frombuffer(body, np.int64, 2 * n, 16 + 32 * m).reshape(2, n).tolist()
        at, last, terms = 16 + 32 * m + 16 * n, b"", []
        for k, s in zip(shared, size, strict=True):
            last = last[:k] + bytes(body[at : at + s])
            terms.append(last)
            at += s
        return cls(terms, leaf, group, count, docs)


def _summed(leaf: np.ndarray, group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((group, leaf))
    leaf, group = leaf[order], group[order]
    start = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (group[1:] != group[:-1])]) if len(leaf) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x[order], start) if len(start) else x
    return leaf[start], group[start], add(count), add(docs)


def count_terms(raw: np.ndarray, cuts: np.ndarray, groups: np.ndarray) -> Trie:
    """The trie of some texts that stand one after another; groups: of each text."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    ink = _INK[raw]
    begin = np.flatnonzero(ink & (np.r_[True, ~ink[:-1]] | edge[:-1]))
    end = np.flatnonzero(ink & (np.r_[~ink[1:], True] | edge[1:])) + 1
    folded = _FOLD[raw]
    _, some, of = np.unique(hashes(folded, begin, end), return_index=True, return_inverse=True)
    whole = folded.tobytes()
    terms = [whole[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
    order = sorted(range(len(terms)), key=terms.__getitem__)
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    doc = np.searchsorted(cuts, begin, side="right") - 1
    pair, count = np.unique(doc * max(1, len(terms)) + place[of], return_counts=True)
    doc, leaf = np.divmod(pair, max(1, len(terms)))
    return Trie([terms[k] for k in order], *_summed(leaf, groups[doc], count.astype(np.int64), np.ones(len(pair), np.int64)))


_PIECE = "range int, langs array<string>, sources array<string>, trie binary"


def _pieces(trie: Trie, groups: dict[tuple[str, str], int], cuts: list[bytes]):
    from bisect import bisect_left

    edges = [0, *(bisect_left(trie.terms, c) for c in cuts), len(trie.terms)]
    langs, sources = [g[0] for g in groups], [g[1] for g in groups]
    for k, (lo, hi) in enumerate(pairwise(edges)):
        if lo < hi:
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_pydict({"range": pa.array([k], pa.int32()), "langs": pa.array([langs], text), "sources": pa.array([sources], text), "trie": pa.array([trie.piece(lo, hi).dump()], pa.binary())})


def _counted(cuts: list[bytes]):
    """From (text, lang, source) to pieces of tries."""

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        small: list[Trie] = []
        for batch in batches:
            raw, at = texts_of(batch.column(0))
            own = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
            for lo, hi in slices(at):
                small.append(count_terms(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], own[lo:hi]))
                if sum(len(t.terms) for t in small) > LEAVES:
                    small = [Trie.merged(small)]
                    if len(small[0].terms) > LEAVES // 2:
                        yield from _pieces(small.pop(), groups, cuts)
        if small:
            yield from _pieces(Trie.merged(small), groups, cuts)

    return run


_KEPT = "lang string, sources array<string>, sums array<long>, n_terms long, trie binary"


def _merge(min_docs: int):
    """All pieces of a range; for each language the kept terms."""

    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple[str, str], int] = {}
        tries = []
        for row in table.to_pylist():
            trie = Trie.load(row["trie"])
            trie.group = np.array([groups.setdefault(g, len(groups)) for g in zip(row["langs"], row["sources"], strict=True)], np.int64)[trie.group]
            tries.append(trie)
        trie, rows = Trie.merged(tries), []
        lang_of = np.array([g[0] for g in groups], object)
        for lang in dict.fromkeys(lang_of):
            own = np.flatnonzero(lang_of == lang)
            here = np.isin(trie.group, own)
            leaves = np.bincount(trie.leaf[here], trie.docs[here], len(trie.terms)) >= min_docs
            if leaves.any():
                kept = trie.chosen(leaves, here)
                kept.group = np.searchsorted(own, kept.group)
                sums = np.zeros(len(own), np.int64)
                np.add.at(sums, kept.group, kept.count)
                rows.append((lang, [list(groups)[k][1] for k in own], sums.tolist(), len(kept.terms), kept.dump()))
        kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary())
        return pa.table({c: pa.array([r[k] for r in rows], kinds[k]) for k, c in enumerate(("lang", "sources", "sums", "n_terms", "trie"))})

    return run


def shares(count: np.ndarray, total: np.ndarray | int, scale_digits: int = 9) -> np.ndarray:
    """1 + floor(10^digits * (count + 1) / total), three digits at a time, so that nothing overflows."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(scale_digits // 3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_SAID = "lang string, source string, part string, item string, value long"


def _traverse(top: int):
    """Rows with trie, own sources, all groups of the language and its V: partial sums of pairs, and each source's first terms."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield _traversed(batch.slice(k, 1).to_pylist()[0], top)

    return run


def _traversed(row: dict, top: int) -> pa.RecordBatch:
    trie, sources = Trie.load(row["trie"]), [g["source"] for g in row["groups"]]
    n = np.array([g["n"] for g in row["groups"]], np.int64)
    own = {s: k for k, s in enumerate(sources)}
    column = np.array([own[s] for s in row["sources"]], np.int64)[trie.group]
    sums = np.zeros((len(sources), len(sources)), np.int64)
    best: list[list[tuple[int, int]]] = [[] for _ in sources]
    for lo in range(0, len(trie.terms), _BLOCK):
        hi = min(lo + _BLOCK, len(trie.terms))
        a, b = np.searchsorted(trie.leaf, (lo, hi))
        count = np.zeros((len(sources), hi - lo), np.int64)
        count[column[a:b], trie.leaf[a:b] - lo] = trie.count[a:b]
        p = shares(count, (n + row["v"])[:, None])
        q = shares(count.sum(0), int(n.sum()) + row["v"])
        for s in range(len(sources)):
            sums[s] += _apart(p[s], p).sum(1)
            some = np.flatnonzero((count[s] > 0) & (p[s] > q))
            value = _apart(p[s][some], q[some])
            first = np.argsort(-value, kind="stable")[:top]
            best[s] = sorted([*best[s], *zip((-value[first]).tolist(), (some[first] + lo).tolist(), strict=True)])[:top]
    out = [(sources[s], "pair", sources[t], int(sums[s, t])) for s in range(len(sources)) for t in range(len(sources)) if s != t]
    out += [(sources[s], "term", trie.terms[k].decode(), -v) for s in range(len(sources)) for v, k in best[s]]
    return pa.RecordBatch.from_pydict({"lang": pa.array([row["lang"]] * len(out), pa.string()), **{c: pa.array([r[k] for r in out], pa.int64() if c == "value" else pa.string()) for k, c in enumerate(("source", "part", "item", "value"))}})


def _cuts(texts: DataFrame) -> list[bytes]:
    """Where tries are cut: quantiles of the terms of some documents; more of them the more text there is."""
    rows = texts.count()
    some = texts.where(F.rand(17) < SAMPLE / rows) if rows > SAMPLE else texts
    size, n = some.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))
    terms = sorted(r[0].encode() for r in some.select(F.explode(words).alias("term")).distinct().limit(SAMPLED).collect())
    ranges = max(RANGES, math.ceil(rows * (size or 0) / max(n, 1) / RANGE))
    return sorted({terms[len(terms) * k // ranges] for k in range(1, ranges)}) if terms else []


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    with scratch() as keep:
        texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
        pieces = texts.mapInArrow(_counted(_cuts(texts)), _PIECE)
        kept = stored(pieces.groupBy("range").applyInArrow(_merge(min_docs), _KEPT), "kept")
        groups = texts.select("lang", "source").distinct()
        zipped = F.explode(F.arrays_zip("sources", "sums")).alias("s")
        counts = kept.select("lang", zipped).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("n"))
        groups = stored(groups.join(counts, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
        of_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
        of_lang = of_lang.join(kept.groupBy("lang").agg(F.sum("n_terms").alias("v")), "lang")
        said = stored(kept.join(of_lang, "lang").select("lang", "sources", "groups", "v", "trie").mapInArrow(_traverse(top), _SAID), "said")
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
        sums = said.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
        terms = said.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return keep(stored(pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms), "audit"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v))::BIGINT AS q, v.v
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, q, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p FROM x),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) WHERE part = 'pair' OR rank <= 200
"""
