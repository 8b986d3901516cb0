"""Passages that documents with smaller ids hold as well, found by prefix-free parsing.

Texts are bytes. A position is repeated if the `length` bytes from it on also start in a document with a smaller id; every byte under a
repeated position is removed.

Parsing. Rolling hashes of all grams of `gram` bytes; of the grams within each window of `length` bytes the one with the least hash, the
first of equals, is its trigger. So equal windows have equal triggers at equal places, wherever they stand, and none is without. A phrase is
a trigger with the bytes of all its windows: what comes before the trigger (at most length - gram bytes) and what comes from it on (at most
`length`). A text is its sequence of phrases.

Corpus order. The first `length` bytes of a suffix of the corpus are a phrase's suffix up to its trigger, then what the parse goes on with
from the trigger. Distinct phrases are sorted by what comes before the trigger, read backwards (the dictionary's suffix array), and by what
comes from it on (the parse's suffix array). Neighbours' common bytes give the class of each at every depth, and the two classes together
are the place of a suffix in corpus order as deep as `length`: windows with both alike are equal, and the smallest id among them decides.

On Spark. Texts are packed into chunks of about CHUNK bytes, written once. A chunk asks, for each of its distinct phrases, a bucket of the
triggers' hashes: the bucket answers with the smallest id that has the phrase, and whether others with the same trigger and smaller ids
have other phrases. In a document with a larger id all windows of the phrase are repeated. Only for the document with the smallest id do
other phrases matter, so its chunk alone sends the phrase's bytes to be ordered, and gets back which of the windows are repeated. A trigger
that has many phrases (more than `wild` in a chunk, or than `hot` in all) would make its bucket large: its windows are asked for one by one, by
128 bits of hash, and meet others in as many buckets as there are windows. A bucket has at most `wild` entries of a trigger for each chunk.

Nulls: a text that is null counts as empty; a row without an id takes no part and comes out whole. Rows that repeat an id are judged alike,
none against the other. Empty tables give empty ones. Texts of any length, but a text must fit in a task several times over. Only id and text
are read,
so other columns can have any names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import U64, discard, mix, scratch, slices, stored, texts_of

CHUNK = 1 << 20  # bytes of text, about
GRAM = 20  # bytes of a trigger
BUCKETS = 256  # at least
BUCKET = 16 << 20  # bytes that a bucket is asked, about
ORDERED = 40_000  # phrases that are ordered in one task, about
WILD = 16  # phrases of a trigger in one chunk
HOT = 20_000  # phrases of a trigger in a bucket
_SEGMENT = 1 << 15  # positions that are parsed at once: what stays in a core's cache
_PLACE = U64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.int64).max

_CHUNKS = "ids array<long>, sizes array<long>, n_bytes long, body binary"
_ASKS = "bucket int, chunk long, body binary"
_ANSWERS = "chunk long, kind int, body binary, n_sent long"


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all grams of n bytes, by doubling."""
    now, size, factor, out, done = raw.astype(U64) + U64(1), 1, _BASE, None, 0
    while True:
        if n & size:
            out = now if out is None else out[: len(raw) - done - size + 1] * U64(factor) + now[done : done + len(raw) - done - size + 1]
            done += size
        if size * 2 > n:
            return (out ^ (out >> U64(29))) * U64(_BASE)
        now = now[:-size] * U64(factor) + now[size:]
        factor, size = factor * factor % 2**64, size * 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n in a row."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _lanes(raw: np.ndarray) -> np.ndarray:
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


def _digest(lanes: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int, salt: np.ndarray | int = 0) -> np.ndarray:
    """64 bits of hash of each piece of a buffer, eight bytes at a time."""
    out = mix((size.astype(U64) << U64(8)) + U64(seed) + np.asarray(salt, U64) * U64(1 << 32))
    some, at = np.arange(len(begin)), 0
    while len(some):
        left = size[some] - at
        lane = lanes[begin[some] + at]
        cut = left < 8
        lane[cut] &= (U64(1) << (U64(8) * left[cut].astype(U64))) - U64(1)
        out[some] = mix(out[some] * U64(_BASE) + mix(lane + U64(seed)))
        some, at = some[left > 8], at + 8
    return out


class Parse:
    """The phrases of a chunk: first and last window, trigger and its hash of each occurrence; the distinct ones, sorted by the trigger's
    hash and the phrase's, with their smallest document and whether there are others."""

    def __init__(self, chunk: dict, length: int, gram: int):
        self.raw = np.frombuffer(chunk["body"], np.uint8)
        self.cuts = np.r_[0, np.cumsum(np.asarray(chunk["sizes"], np.int64))]
        ids = chunk["ids"]
        self.ids = np.array([_NONE if i is None else i for i in ids], np.int64)
        fits = np.ones(len(self.raw), bool)
        for k, i in enumerate(ids):
            lo, hi = self.cuts[k], self.cuts[k + 1]
            fits[lo if i is None else max(lo, hi - length + 1) : hi] = False
        found = [self._segment(fits, lo, length, gram) for lo in range(0, len(self.raw) - length + 1, _SEGMENT)] or [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)]
        self.first, self.last, self.at, self.trigger = (np.concatenate(x) for x in zip(*found, strict=True))
        self.length, self.lanes = length, _lanes(self.raw)
        self.doc = self.ids[np.searchsorted(self.cuts, self.first, side="right") - 1]
        phrase = _digest(self.lanes, self.first, self.last + length - self.first, 1, self.at - self.first)
        order = np.lexsort((phrase, self.trigger))
        t, p = self.trigger[order], phrase[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1])] if len(t) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        self.entry = np.empty(len(t), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.triggers, self.phrases, self.some = t[start], p[start], order[start]
        d = self.doc[order]
        self.lowest = np.minimum.reduceat(d, start) if len(start) else d
        self.several = (np.maximum.reduceat(d, start) if len(start) else d) != self.lowest

    def _segment(self, fits: np.ndarray, lo: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        piece = self.raw[lo : lo + _SEGMENT + length - 1]
        h = _grams(piece, gram)
        best = _least((h & ~_PLACE) | np.arange(len(h), dtype=U64), length - gram + 1) & _PLACE
        i = np.flatnonzero(fits[lo : lo + len(best)])
        best = best[i].astype(np.int64)
        new = np.r_[True, (best[1:] != best[:-1]) | (i[1:] != i[:-1] + 1)] if len(i) else np.zeros(0, bool)
        at = best[new]
        return i[new] + lo, i[np.r_[new[1:], True]] + lo if len(i) else i, at + lo, mix(h[at])  # least ones lie close together, buckets want them apart

    def wild(self, most: int) -> np.ndarray:
        """Of the distinct phrases, those whose trigger has more than `most` of them here."""
        new = np.r_[True, self.triggers[1:] != self.triggers[:-1]] if len(self.triggers) else np.zeros(0, bool)
        count = np.diff(np.r_[np.flatnonzero(new), len(self.triggers)])
        return (count > most)[np.cumsum(new) - 1] if len(self.triggers) else new

    def windows(self, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of occurrences of these distinct phrases: places, the distinct ones' hashes, smallest documents and whether there are
        others, and which of these each place has."""
        j = np.flatnonzero(hot[self.entry])
        n = self.last[j] - self.first[j] + 1
        at = np.repeat(self.first[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        doc, size = np.repeat(self.doc[j], n), np.full(len(at), self.length)
        a, b = _digest(self.lanes, at, size, 2), _digest(self.lanes, at, size, 3)
        order = np.lexsort((b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(at) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(doc[order], start) if len(start) else doc
        return at, doc, a[order][start], b[order][start], low, (np.maximum.reduceat(doc[order], start) if len(start) else doc) != low, of


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, one after another."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = len(body) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(body, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_ASK = ("<u8", "<u8", "<i8", "<u4", "u1")  # trigger, phrase, smallest document, place among the chunk's distinct phrases, 1: several documents, 2: wild
_ANSWER = ("<u4", "<i8", "u1")  # place, smallest document, 1: send the bytes, 2: ask for its windows
_WINDOW = ("<u8", "<u8", "<i8", "<u4", "u1")


def _split(keys: np.ndarray, buckets: int):
    """Slices of sorted hashes by bucket, a bucket being a range of hashes."""
    b = (keys >> U64(32)) * U64(buckets) >> U64(32)
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(b[lo]), slice(lo, hi)


def _chunks(batches):
    for batch in batches:
        raw, cuts = texts_of(batch.column(1))
        for lo, hi in slices(cuts, CHUNK):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            yield pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([np.diff(cuts[lo : hi + 1])], pa.list_(pa.int64())), "n_bytes": pa.array([int(cuts[hi] - cuts[lo])], pa.int64()), "body": pa.array([raw[cuts[lo] : cuts[hi]].tobytes()], pa.binary())})


def _one_by_one(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _asked(rows: list[tuple], schema: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "chunk": pa.int64(), "n_sent": pa.int64(), "body": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], kinds[c]) for k, c in enumerate(schema)})


def _ask(length: int, gram: int, buckets: int, wild_over: int):
    def run(batches):
        for chunk in _one_by_one(batches):
            p = Parse(chunk, length, gram)
            wild = p.wild(wild_over)
            ask = ~wild | np.r_[True, p.triggers[1:] != p.triggers[:-1]][: len(wild)]  # a wild trigger asks once
            columns = [x[ask] for x in (p.triggers, p.phrases, p.lowest, np.arange(len(ask), dtype=np.uint32), (p.several + 2 * wild).astype(np.uint8))]
            yield _asked([(b, chunk["chunk"], _pack(*[c[at] for c in columns])) for b, at in _split(columns[0], buckets)], ("bucket", "chunk", "body"))

    return run


def _gathered(table: pa.Table, kinds: tuple[str, ...]) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """What a bucket is asked: the chunks, which of them each entry is from, and the entries' columns."""
    parts = [_unpack(b.as_buffer(), *kinds) for b in table.column("body")]
    of = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
    return table.column("chunk").to_pylist(), of, [np.concatenate(x) for x in zip(*parts, strict=True)]


def _replies(chunks: list[int], of: np.ndarray, keep: np.ndarray, kind: int, columns: list[np.ndarray], sent: np.ndarray | None = None) -> pa.Table:
    """What is kept of the entries, back to the chunks; entries of a chunk stand together."""
    edges = np.searchsorted(of, np.arange(len(chunks) + 1))
    rows = []
    for k, chunk in enumerate(chunks):
        some = np.flatnonzero(keep[edges[k] : edges[k + 1]]) + edges[k]
        if len(some):
            rows.append((chunk, kind, _pack(*[c[some] for c in columns]), int(sent[some].sum()) if sent is not None else 0))
    return pa.Table.from_batches([_asked(rows, ("chunk", "kind", "body", "n_sent"))])


def _answer_phrases(hot_over: int):
    def run(table: pa.Table) -> pa.Table:
        chunks, of, (t, p, low, place, said) = _gathered(table, _ASK)
        order = np.lexsort((low, p, t))
        new_t = np.r_[True, t[order][1:] != t[order][:-1]]
        new_p = new_t | np.r_[True, p[order][1:] != p[order][:-1]]
        at_t, at_p = np.flatnonzero(new_t), np.flatnonzero(new_p)
        g_t, g_p = np.cumsum(new_t) - 1, np.cumsum(new_p) - 1
        first = low[order][at_p]  # of each phrase
        per = np.add.reduceat(new_p.astype(np.int64), at_t)
        hot = (np.maximum.reduceat(said[order] & 2, at_t) > 0) | (per > hot_over)
        begin = g_t[at_p]  # trigger of each phrase
        edge = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]])
        mixed = np.minimum.reduceat(first, edge) != np.maximum.reduceat(first, edge)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        f, is_hot = first[g_p][back], hot[g_t][back]
        send = mixed[g_t][back] & (f == low) & ~is_hot
        late = ((said & 1) > 0) | (low > f)
        return _replies(chunks, of, send | late | is_hot, 0, [place, f, (send + 2 * is_hot).astype(np.uint8)], send)

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    chunks, of, (a, b, low, place, said) = _gathered(table, _WINDOW)
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    g = np.empty_like(order)
    g[order] = np.cumsum(new) - 1
    first = np.minimum.reduceat(low[order], np.flatnonzero(new))[g]
    return _replies(chunks, of, (first < low) | (said > 0), 2, [place, first])


def _answered(p: Parse, bodies: list[bytes], wild_over: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunk's distinct phrases: the smallest document of each that must know it, those to send, those whose windows are asked for."""
    first, send, hot = np.full(len(p.triggers), _NONE), np.zeros(len(p.triggers), bool), p.wild(wild_over)
    for body in bodies:
        place, f, said = _unpack(body, *_ANSWER)
        first[place], send[place] = f, (said & 1) > 0
        hot[place] |= (said & 2) > 0
    if hot.any():
        hot = np.isin(p.triggers, p.triggers[hot])
    return first, send & ~hot, hot


def _sort_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many leading bytes each has in common with the one before it in that order."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    order = np.lexsort(wide.view(">u8").T[::-1])
    differ = rows[order[1:]] != rows[order[:-1]]
    return order, np.r_[0, np.where(differ.any(1), differ.argmax(1), rows.shape[1])]


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Rows with the same first `depth` bytes have the same number, in order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated_windows(before: np.ndarray, after: np.ndarray, n_before: np.ndarray, n_after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrases: rows of the bytes before the trigger, read backwards, and of those from it on, filled up with zeros. Bit k: the window that
    begins k bytes before the trigger is also one of a phrase whose `first` is smaller."""
    length = after.shape[1]
    dictionary, parse = _sort_order(before), _sort_order(after)
    out = np.zeros(len(first), U64)
    for k in range(before.shape[1] + 1):
        some = np.flatnonzero((n_before >= k) & (n_after >= length - k))
        if not len(some):
            continue
        place = (_classes(*parse, length - k) * (len(first) + 1) + _classes(*dictionary, k))[some]
        order = np.argsort(place, kind="stable")
        new = np.r_[True, place[order][1:] != place[order][:-1]]
        least = np.minimum.reduceat(first[some][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = some[order][least < first[some][order]]
        out[hit] |= U64(1) << U64(k)
    return out


def _order_phrases(length: int, gram: int):
    n = length - gram
    kinds = (f"({n},)u1", f"({length},)u1", "u1", "u1", "<i8", "<u4")

    def run(table: pa.Table) -> pa.Table:
        chunks, of, (before, after, n_before, n_after, first, place) = _gathered(table, kinds)
        mask = repeated_windows(before, after, n_before.astype(np.int64), n_after.astype(np.int64), first)
        return _replies(chunks, of, mask > 0, 1, [place, mask])

    return run


def _send(length: int, gram: int, ordered: int, buckets: int, wild_over: int):
    """The bytes of phrases that are to be ordered (kind 0), and the windows of hot triggers (kind 1)."""
    n = length - gram

    def run(key, text: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, rows = text.to_pylist()[0], []
        p = Parse(chunk, length, gram)
        first, send, hot = _answered(p, answers.column("body").to_pylist(), wild_over)
        some = np.flatnonzero(send)
        j = p.some[some]
        wide = np.concatenate([np.zeros(n, np.uint8), p.raw, np.zeros(length, np.uint8)])
        n_before, n_after = p.at[j] - p.first[j], p.last[j] + length - p.at[j]
        before = wide[(p.at[j] + n - 1)[:, None] - np.arange(n)] * (np.arange(n) < n_before[:, None])
        after = wide[(p.at[j] + n)[:, None] + np.arange(length)] * (np.arange(length) < n_after[:, None])
        columns = [before, after, n_before.astype(np.uint8), n_after.astype(np.uint8), first[some], some.astype(np.uint32)]
        rows += [(0, b, chunk["chunk"], _pack(*[c[at] for c in columns])) for b, at in _split(p.triggers[some], ordered)]
        if hot.any():
            _, _, a, b, low, several, _ = p.windows(hot)
            columns = [a, b, low, np.arange(len(a), dtype=np.uint32), several.astype(np.uint8)]
            rows += [(1, k, chunk["chunk"], _pack(*[c[at] for c in columns])) for k, at in _split(a, buckets)]
        return pa.Table.from_batches([_asked(rows, ("kind", "bucket", "chunk", "body"))])

    return run


def _cut(length: int, gram: int, wild_over: int):
    """What is left of a chunk's texts, and what goes."""

    def run(key, text: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = text.to_pylist()[0]
        p = Parse(chunk, length, gram)
        bodies = {kind: [b for k, b in zip(answers.column("kind").to_pylist(), answers.column("body").to_pylist(), strict=True) if k == kind] for kind in range(3)}
        first, _, hot = _answered(p, bodies[0], wild_over)
        first[hot] = _NONE
        edge = np.zeros(len(p.raw) + 1, np.int32)
        gone = first[p.entry] < p.doc
        np.add.at(edge, p.first[gone], 1)
        np.add.at(edge, p.last[gone] + length, -1)
        mask = np.zeros(len(p.triggers), U64)
        for body in bodies[1]:
            place, m = _unpack(body, "<u4", "<u8")
            mask[place] = m
        own = np.flatnonzero((first[p.entry] == p.doc) & (mask[p.entry] > 0))
        for k in range(length - gram + 1):
            at = p.at[own[(mask[p.entry[own]] >> U64(k)) & U64(1) > 0]] - k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        if hot.any():
            at, doc, a, _, _, _, of = p.windows(hot)
            least = np.full(len(a), _NONE)
            for body in bodies[2]:
                place, f = _unpack(body, "<u4", "<i8")
                least[place] = f
            at = at[least[of] < doc]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        out = np.cumsum(edge[:-1]) > 0
        border = np.zeros(len(p.raw) + 1, bool)
        border[p.cuts] = True
        begin = np.flatnonzero(out & (np.r_[True, ~out[:-1]] | border[:-1]))
        end = np.flatnonzero(out & (np.r_[~out[1:], True] | border[1:])) + 1
        lo = np.searchsorted(begin, p.cuts)
        spans = [[{"begin": int(b - c), "end": int(e - c)} for b, e in zip(begin[x:y], end[x:y], strict=True)] for x, y, c in zip(lo[:-1], lo[1:], p.cuts[:-1], strict=True)]
        left = [p.raw[a:b][~out[a:b]].tobytes() for a, b in zip(p.cuts[:-1], p.cuts[1:], strict=True)]
        return pa.table({"id": pa.array(chunk["ids"], pa.int64()), "n_bytes": pa.array(chunk["sizes"], pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(left, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = GRAM, wild: int = WILD, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, spans, kept) for each row of docs: the text's bytes, the maximal runs of bytes that go ([begin, end), in order), and
    the bytes that stay, which needn't be UTF-8 any more. Ids are whole numbers. gram < length <= gram + 63. wild, hot: from how many phrases of a trigger, in a chunk or
    in a bucket, windows are asked for one by one; results don't depend on them."""
    if not 0 < gram < length <= gram + 63:
        raise ValueError("the gram must be shorter than the length, by 63 bytes at most")
    with scratch() as keep:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        chunks = stored(texts.mapInArrow(_chunks, _CHUNKS).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")
        n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
        buckets = max(BUCKETS, math.ceil(n_bytes * 2 / (length - gram + 2) * 29 / BUCKET))
        asks = chunks.mapInArrow(_ask(length, gram, buckets, wild), _ASKS)
        answers = stored(asks.groupBy("bucket").applyInArrow(_answer_phrases(hot), _ANSWERS), "answers")
        sent = answers.agg(F.sum("n_sent")).first()[0] or 0
        ordered = max(BUCKETS, math.ceil(sent / ORDERED))
        more = stored(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send(length, gram, ordered, buckets, wild), f"kind int, {_ASKS}"), "sent")
        masks = more.where("kind = 0").drop("kind").groupBy("bucket").applyInArrow(_order_phrases(length, gram), _ANSWERS)
        singly = more.where("kind = 1").drop("kind").groupBy("bucket").applyInArrow(_answer_windows, _ANSWERS)
        said = stored(masks.union(singly), "masks")
        discard(more)
        schema = "id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
        out = chunks.groupBy("chunk").cogroup(answers.union(said).groupBy("chunk")).applyInArrow(_cut(length, gram, wild), schema)
        return keep(stored(out.withColumnRenamed("id", id_col), "repeats"))
