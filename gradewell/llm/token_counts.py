"""Token counts: byte-fallback BPE by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch stand one after another in one flat array of symbols. Between two characters that no piece
has side by side no merge can happen, so a pre-token is as many sequences as it has such places. In each round every sequence applies its
lowest-ranked pair, all sequences at once, and the ranks beside what was merged are looked up again; sequences without a pair leave. What
survives is counted. Counts of pre-tokens are kept in a bounded cache of the Python worker, so common words are merged once.

Null or empty text: 0 bytes, 0 tokens. A text of any length is counted whole; a run without spaces may be one long sequence. Rows that
repeat an id are counted one by one. Other columns are not read, whatever their names; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradewell.llm.common import portions
from gradewell.llm.pieces import SPACE, PieceTable, model_path, parts_of, piece_table

CACHE = 400_000  # pre-tokens a worker remembers
FLAT = 1 << 20  # characters merged at once


def merged_lengths(table: PieceTable, parts: list[str]) -> np.ndarray:
    """Tokens of each pre-token."""
    out = np.zeros(len(parts), np.int64)
    start, room = 0, 0
    for k in range(len(parts) + 1):
        if k == len(parts) or (room and room + len(parts[k]) > FLAT):
            if k > start:
                out[start:k] = _merge(table, parts[start:k])
            start, room = k, 0
        if k < len(parts):
            room += len(parts[k])
    return out


def _merge(table: PieceTable, parts: list[str]) -> np.ndarray:
    none = table.size
    never = table.rank[none]
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), length)
    at = np.minimum(np.searchsorted(table.char, code), len(table.char) - 1)
    sym = np.where(table.char[at] == code, table.char_id[at], none)
    width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    out = np.bincount(part, np.where(sym == none, width, 0), len(parts)).astype(np.int64)  # bytes of characters without a piece; these never merge
    new = np.zeros(len(code), bool)
    new[table.apart(code) if len(code) else []] = True
    new[1:] |= part[1:] != part[:-1]
    seq = np.cumsum(new)
    of = part[np.flatnonzero(np.r_[True, new[1:]])] if len(code) else part
    whole = np.bincount(seq[sym != none], minlength=len(of)) if len(code) else np.zeros(0, np.int64)  # symbols left of each sequence
    m = np.full(len(sym), none, np.int64)
    m[:-1] = np.where(seq[:-1] == seq[1:], table.merge_of(sym[:-1], sym[1:]), none)
    rank = table.rank[m]
    while len(sym) > 1:
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(seq)])
        live = low < never
        if not live.any():
            break
        # in a run of overlapping pairs every second one is free
        p = np.flatnonzero((rank == np.repeat(low, size)) & (rank < never))
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(p) > 1], np.arange(len(p)), 0))
        p = p[(np.arange(len(p)) - run) % 2 == 0]
        # in order, up to the first whose merge makes a pair that goes before its own rank
        made, own = m[p], rank[p]
        left = np.where((p > 0) & (seq[np.maximum(p - 1, 0)] == seq[p]), sym[np.maximum(p - 1, 0)], none)
        left = np.where(np.r_[False, (np.diff(p) == 2) & (seq[p[1:]] == seq[p[:-1]])], np.r_[none, made[:-1]], left)
        after = np.minimum(p + 2, len(sym) - 1)
        right = np.where((p + 2 < len(sym)) & (seq[after] == seq[p]), sym[after], none)
        early = (table.rank[table.merge_of(left, made)] <= own) | (table.rank[table.merge_of(made, right)] <= own)
        before = np.cumsum(early) - early
        base = before[np.searchsorted(seq[p], seq[p])]
        p, made = p[before == base], made[before == base]
        sym[p] = made
        np.subtract.at(whole, seq[p], 1)
        keep = np.repeat(live, size)
        keep[p + 1] = False
        at = np.cumsum(keep)[p] - 1
        sym, seq, m, rank = sym[keep], seq[keep], m[keep], rank[keep]
        # only pairs beside what was merged are others now
        beside = np.r_[at, at[at > 0] - 1]
        next_ = np.minimum(beside + 1, len(sym) - 1)
        m[beside] = np.where((seq[beside] == seq[next_]) & (next_ > beside), table.merge_of(sym[beside], sym[next_]), none)
        rank[beside] = table.rank[m[beside]]
    return out + np.bincount(of, whole, len(parts)).astype(np.int64)


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    table, cache = piece_table(path), {}
    for batch in portions(batches):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), 200):
            some = texts[lo : lo + 200]
            cut = [parts_of(t.replace(SPACE, " ") if t and SPACE in t else t) for t in some]
            new = list(set().union(*cut).difference(cache))
            cache.update(zip(new, merged_lengths(table, new).tolist(), strict=True))
            for k, (t, x) in enumerate(zip(some, cut, strict=True)):
                n_bytes[lo + k] = len(t.encode("utf-8", "surrogatepass")) if t else 0
                n_tokens[lo + k] = sum(map(cache.__getitem__, x))
            if len(cache) > CACHE:
                cache.clear()
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs, no shuffle.

    model: a file of the public tokenizers, or a path that every executor has."""
    path = model if "/" in model else model_path(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(id_col, text_col).mapInArrow(lambda it: count_batches(it, path, limit), schema)
