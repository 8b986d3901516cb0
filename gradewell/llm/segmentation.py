"""SentencePiece encoding by forward filtering and backward sampling, and its lossless decoding.

Every way to write a text as pieces is a path through a lattice. Its weight is the product of its pieces' probabilities, which a BPE
model doesn't hold: they follow Zipf's law in the merge rank, to the power of `alpha`. A forward pass sums the weights of all paths
to each position, a backward pass draws the pieces from the end. Pieces never cross a space or a line feed, so the lattice falls into
those of the pre-tokens; each distinct one is filtered once, then all its occurrences in a batch are drawn together. The numbers
behind a draw are hashes of seed, row key, occurrence and step, so a row gets the same pieces wherever and whenever it is encoded.

Decoding gives back exactly the text: characters without a piece, and the mark that stands for a space, go through byte pieces.
Null text: null pieces. Empty text: no pieces. Texts are encoded whole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradewell.llm.common import U64, mix, unused
from gradewell.llm.pieces import PieceTable, model_path, parts_of, piece_table

EDGES = 1_500_000  # lattice edges a worker remembers
GROUP = 400_000  # characters drawn at once


class Lattices:
    """The filtered lattices of distinct pre-tokens, end to end: states are positions, edges lead back from a state."""

    def __init__(self, table: PieceTable, alpha: float):
        self.table = table
        total = math.log(sum(1.0 / k for k in range(1, len(table.id_of) + 1)))
        self.logp = np.full(table.size, -math.inf)
        for i in table.id_of.values():
            self.logp[i] = -alpha * (math.log(table.rank[i] + 1.0) + total)
        self.byte = -alpha * (math.log(len(table.id_of) + 1.0) + total)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of a pre-token
        self.last, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number: end state, characters
        self.first = np.zeros(0, np.int64)  # by state: its first edge
        self.wide: list[bytes] = []  # characters that go as bytes; their codes follow the pieces'
        self.wide_of: dict[int, int] = {}
        self.upto, self.code, self.back = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)  # of edges, a state's longest first; upto: cumulative probability

    def add(self, parts: list[str]) -> None:
        """Forward filtering of pre-tokens, all at once: first the pieces at each place, by the trie, then the sums, position by position."""
        t = self.table
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), n)
        stop, begin = np.cumsum(n), np.cumsum(n) - n
        at, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        begun, ended, codes = [], [], []
        pos = at
        while len(at):
            child = t.child_of(node, chars[pos])
            ok = child >= 0
            at, node, pos = at[ok], child[ok], pos[ok] + 1
            piece = t.node_piece[node]
            hit = piece >= 0
            begun.append(at[hit])
            ended.append(pos[hit])
            codes.append(piece[hit])
            more = pos < stop[part[at]]
            at, node, pos = at[more], node[more], pos[more]
        single = np.zeros(len(chars), bool)
        single[begun[0]] = True
        lost = np.flatnonzero(~single)
        cost = np.zeros(len(lost))
        for k, c in enumerate(chars[lost].tolist()):
            if c not in self.wide_of:
                self.wide_of[c] = len(self.wide)
                self.wide.append(chr(c).encode("utf-8", "surrogatepass"))
            cost[k] = self.byte * len(self.wide[self.wide_of[c]])
        begun, ended = np.concatenate([*begun, lost]), np.concatenate([*ended, lost + 1])
        code = np.concatenate([*codes, np.array([t.size + self.wide_of[c] for c in chars[lost].tolist()], np.int64)])
        logp = np.concatenate([self.logp[np.concatenate(codes)], cost])
        owner = part[begun]
        back, state, depth = begun + owner, ended + owner, ended - begin[owner]  # a pre-token has a state more than characters
        # by state, the longest piece first, which often is the likeliest; no two edges of a state are of one length
        order = np.argsort((state << 21) + np.maximum((1 << 21) - 1 - (ended - begun), 0))
        back, state, depth, code, logp = (x[order] for x in (back, state, depth, code, logp))
        a = np.zeros(len(chars) + len(parts))
        weight = np.empty(len(back))
        level = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 65536 else depth, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(depth[level]) != 0, True])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            e = level[lo:hi]
            s = state[e]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            w = a[back[e]] + logp[e]
            top = np.maximum.reduceat(w, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, hi - lo]))
            w = np.exp(w - top[of])
            whole = np.add.reduceat(w, first)
            a[s[first]] = top + np.log(whole)
            weight[e] = w / whole[of]
        first = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        size = np.diff(np.r_[first, len(state)])
        total = np.cumsum(weight)
        upto = total - np.repeat(total[first] - weight[first], size)
        upto[first + size - 1] = 2.0
        base = len(self.first)
        at = np.zeros(len(a), np.int64)
        at[state[first]] = len(self.upto) + first
        self.first = np.concatenate([self.first, at])
        self.upto = np.concatenate([self.upto, upto])
        self.code = np.concatenate([self.code, code.astype(np.int32)])
        self.back = np.concatenate([self.back, base + back])
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))
        self.last = np.concatenate([self.last, base + stop + np.arange(len(parts))])
        self.length = np.concatenate([self.length, n])


def draw(lat: Lattices, cut: list[list[str]], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling: the piece ids of all texts, one after another, and how many each has."""
    if new := list(set().union(*cut).difference(lat.number)):
        lat.add(new)
    per = np.fromiter(map(len, cut), np.int64, len(cut))
    total = int(per.sum())
    if not total:
        return np.zeros(0, np.int32), per
    number = np.fromiter(map(lat.number.__getitem__, chain.from_iterable(cut)), np.int64, total)
    end = lat.last[number]
    first = end - lat.length[number]
    text_of = np.repeat(np.arange(len(cut)), per)
    start = np.cumsum(per) - per
    seed = mix(mix(seeds[text_of]) + (np.arange(total) - start[text_of]).astype(U64))
    state, who, steps, drawn = end, np.arange(total), [], []
    count = np.zeros(total, np.int64)
    step = 0
    while len(who):
        u = (mix(seed[who] + U64(step * 0x9E3779B97F4A7C15 % 2**64)) >> U64(12)).astype(np.float64) * 2.0**-52
        edge = lat.first[state]
        on = np.flatnonzero(lat.upto[edge] <= u)
        while len(on):
            edge[on] += 1
            on = on[lat.upto[edge[on]] <= u[on]]
        steps.append(who)
        drawn.append(lat.code[edge])
        count[who] += 1
        state = lat.back[edge]
        going = state > first[who]
        who, state, step = who[going], state[going], step + 1
    place = np.cumsum(count) - 1  # of a pre-token's last piece, which is drawn first
    out = np.empty(int(count.sum()), np.int32)
    for k, (w, c) in enumerate(zip(steps, drawn, strict=True)):
        out[place[w] - k] = c
    n = np.add.reduceat(np.r_[count, 0], np.minimum(start, total)) * (per > 0)
    if (out >= lat.table.size).any():
        owner = np.repeat(np.arange(len(cut)), n)
        byte_ids = [lat.table.byte_id[np.frombuffer(b, np.uint8)] for b in lat.wide]
        length = np.ones(len(out), np.int64)
        wide = np.flatnonzero(out >= lat.table.size)
        length[wide] = np.array([len(b) for b in byte_ids])[out[wide] - lat.table.size]
        at = np.cumsum(length) - length
        full = np.repeat(out, length)
        for j in range(4):
            x = wide[length[wide] > j]
            full[at[x] + j] = np.array([b[j] if len(b) > j else 0 for b in byte_ids])[out[x] - lat.table.size]
        n = np.bincount(owner, length, len(cut)).astype(np.int64)
        out = full
    return out, n


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, alpha: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Last two columns: row key and text. All but the key are passed on, pieces appended."""
    lat = Lattices(piece_table(path), alpha)
    for batch in batches:
        lo, widths = 0, [n or 0 for n in pc.utf8_length(batch.column(batch.num_columns - 2)).to_pylist()]
        while lo < batch.num_rows or not batch.num_rows:
            hi, room = lo, 0
            while hi < len(widths) and (hi == lo or room + widths[hi] <= GROUP):
                room += widths[hi]
                hi += 1
            some = batch.slice(lo, hi - lo)
            keys, texts = some.column(some.num_columns - 1).to_pylist(), some.column(some.num_columns - 2).to_pylist()
            seeds = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], U64)
            ids, n = draw(lat, [parts_of(t) for t in texts], seeds)
            pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], pieces], [*some.schema.names[:-1], "pieces"])
            lo = hi
            if len(lat.upto) > EDGES:
                lat.clear()
            if not batch.num_rows:
                break


def decode_batches(batches: Iterator[pa.RecordBatch], path: str, at: int, name: str) -> Iterator[pa.RecordBatch]:
    of = piece_table(path).bytes_of
    for whole in batches:
        for lo in range(0, max(whole.num_rows, 1), 500):
            batch = whole.slice(lo, 500)
            flat, length = np.asarray(batch.column(at).flatten()), pc.list_value_length(batch.column(at)).to_pylist()
            texts, k = [], 0
            for n in length:
                texts.append(None if n is None else b"".join(map(of.__getitem__, flat[k : k + n].tolist()))[1:].decode("utf-8", "surrogatepass"))
                k += n or 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", alpha: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """docs with `pieces`, an array of ids; no shuffle. A column of docs named `pieces` is replaced, others pass whatever their names.
    Rows of one key and text get the same pieces, unless copy_col numbers them: copies get pieces of their own, the first those without a
    number. An empty table gives an empty one."""
    path = model if "/" in model else model_path(model)
    rest = [c for c in docs.columns if c.lower() not in ("pieces", text_col.lower())]
    key = F.col(id_col).cast("string")
    if copy_col:
        key = F.when(F.col(copy_col) > 1, F.concat_ws("#", F.coalesce(key, F.lit("None")), F.col(copy_col).cast("string"))).otherwise(key)
    src = docs.select(*rest, text_col, key.alias(unused("key_of", docs)))
    schema = StructType([*src.schema[:-1], StructField("pieces", ArrayType(IntegerType()))])
    return src.mapInArrow(lambda it: encode_batches(it, path, alpha, seed), schema).select(*[c for c in docs.columns if c.lower() != "pieces"], "pieces")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", name: str = "decoded") -> DataFrame:
    """encoded with the texts that its `pieces` spell; null for null."""
    path = model if "/" in model else model_path(model)
    src = encoded.drop(name)
    at, schema = src.columns.index("pieces"), StructType([*src.schema, StructField(name, StringType())])
    return src.mapInArrow(lambda it: decode_batches(it, path, at, name), schema)
