"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on full shingle sets.

A document's `m` hash collections are `r` minhashes each; a table's key joins two of them, so m * r minhashes serve m * (m - 1) / 2
tables of 2 * r minhashes. With m = 14 and r = 2, 28 minhashes make 91 tables, and a pair of Jaccard similarity 0.8 meets in none of
them with probability 1.6e-5 (0.9: 4e-9). Shared keys are only candidates:

1. Documents with equal shingle sets become one class, kept by its smallest id.
2. In each table entry that several classes share, every class is compared with the smallest and the largest id there, unless their
   sizes differ too much, so there are two rows a class. Ends of entries, components and their sizes
   are aggregates that combine before they are shuffled; they are stored before rows are joined with them, so a small one is sent to all
   tasks, and with a large one a hot key's rows are in a plain shuffle that Spark splits.
3. Links found so far make components. Where an entry still holds classes of several components, pairs between these remain. A pair
   can't reach the threshold if sizes differ too much; if its Jaccard distances to the entry's smallest or largest id, where
   step 2 has computed them, differ by more than the threshold's distance (the triangle inequality); or if too few of its shingles are
   left in its intersection with the smallest id and in documents that are still open, as no others can be in the pair's.
4. What is left is compared. Where an entry holds few documents of small components (CROWD at most), and wherever a component is large, a
   document asks for a component. In crowded entries, such as those of pages with a common frame that are no near-duplicates, documents
   of small components fall into blocks of at most TILE by the smallest of their crowded entries; blocks that meet in an entry are
   compared once, as wholes. So no row is written for a pair there: a set is shuffled once for each block that its own one meets, and what
   grows with the square of an entry is the number of pairs of blocks.

So no candidate that could join two components goes uncompared. Comparison is exact: intersections of the sets of 64-bit shingle
hashes, of all words of the texts (a word's hash is XXH64's rounds over its bytes, a shingle's chains those of its words; two different
shingles of a pair are taken for equal with probability 2^-64). Rows: one for each row of docs, with doc_id, n_shingles, component_id (smallest id reachable,
itself included) and kept (doc_id is component_id).

Null, empty or wordless text: 0 shingles, no links, kept. Null id: no links, component null, kept. Rows that repeat an id count as one
document: they share its component, and it is linked if any of them is. Other columns of docs, of whatever names, are not read. An
empty table gives an empty one. A text of any length is one set; tiles are cut by the shingles that they hold as well as by documents."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import U64, Words, components, discard, mix, portions, scratch, slices, stored, texts_of, windows
from gradewell.llm.vector_dedup import forest

TILE = 256  # documents on a side of a tile
GROUP = 2000  # documents, about, whose tiles are compared in one call
ROOM = 4_000_000  # shingles, about, of the documents of one call, and half of them on a side of a tile; one document may have more
BROADCAST_IDS = 500_000  # ids that may be sent to every task; more are joined by shuffling
CROWD = 64  # documents of small components in an entry that may ask for each other one by one
SALTS = 64  # parts into which the comparisons with one document fall


def shingle_sets(column, n: int) -> Iterator[np.ndarray]:
    """For each text of an Arrow column, the sorted hashes of its distinct shingles."""
    raw, offsets = texts_of(column)
    for lo, hi in slices(offsets):
        words = Words(raw[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo])
        cut = np.searchsorted(words.begin, offsets[lo : hi + 1] - offsets[lo])
        for k in range(hi - lo):
            yield np.unique(windows(words.hash[cut[k] : cut[k + 1]], n))


def _sign(batches: Iterator[pa.RecordBatch], n: int, m: int, r: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**63, (m * r, 1), dtype=np.uint64) * U64(2) + U64(1)
    b = rng.integers(0, 2**63, (m * r, 1), dtype=np.uint64)
    for batch in portions(batches):
        sizes, s1, s2, u = [], [], [], []
        for s in shingle_sets(batch.column(1), n):
            sizes.append(len(s))
            s1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            s2.append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
            if len(s):
                low = np.full(m * r, ~U64(0))
                for lo in range(0, len(s), 4096):
                    low = np.minimum(low, ((s[lo : lo + 4096] ^ b) * a).min(1))
                key = np.zeros(m, np.uint64)
                for k in range(r):
                    key = mix(key * U64(31) + low.reshape(m, r)[:, k])
                u.append(key.view(np.int64))
            else:
                u.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(u, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "s1", "s2", "u"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        rows = [s.view(np.int64) for s in shingle_sets(batch.column(1), n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "set"])


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to join with: sent to every task if they are few, so that texts and sets need not be shuffled for them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, total): sizes of intersection and union. A document that many are compared with is salted by its partners."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    right = salted.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("same"), (F.size("x") + F.size("y")).cast("long").alias("sizes"))
    return both.select("a", "b", "same", (F.col("sizes") - F.col("same")).alias("total"))


def _tile(table: pa.Table, num: int, den: int) -> pa.Table:
    """Rows (tile, asks, id, set): in each tile every asking document against every other; (a, b), a spanning forest of the tile's links."""
    tile, asks, sets = np.asarray(table.column("tile")), np.asarray(table.column("asks")), table.column("set").combine_chunks()
    ids, flat, at = table.column("id").combine_chunks(), np.asarray(sets.values), np.asarray(sets.offsets)
    size = np.diff(at)
    order = np.argsort(tile, kind="stable")
    a, b = [], []
    for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
        x, y = rows[asks[rows]], rows[~asks[rows]]
        if not len(x) or not len(y):
            continue
        fx, fy = (np.concatenate([flat[at[r] : at[r + 1]] for r in z]) for z in (x, y))
        both = np.intersect1d(fx, fy)
        ox, oy = (np.repeat(np.arange(len(z)), size[z]) for z in (x, y))
        kx, ky = np.searchsorted(both, fx), np.searchsorted(both, fy)
        hx, hy = (both[np.minimum(k, len(both) - 1)] == f if len(both) else np.zeros(len(f), bool) for k, f in ((kx, fx), (ky, fy)))
        same = np.zeros((len(x), len(y)), np.int64)
        for lo in range(0, len(both), 8192):
            mx, my = (np.zeros((len(z), min(8192, len(both) - lo)), np.float32) for z in (x, y))
            for m, o, k, h in ((mx, ox, kx, hx), (my, oy, ky, hy)):
                part = h & (k >= lo) & (k < lo + 8192)
                m[o[part], k[part] - lo] = 1
            same += (mx @ my.T).astype(np.int64)
        total = size[x][:, None] + size[y][None, :] - same
        i, j = np.nonzero(same * den >= total * num)
        both, low = np.r_[x, y], forest(len(x) + len(y), i, j + len(x))
        some = np.flatnonzero(low != np.arange(len(low)))
        a.append(both[some])
        b.append(both[low[some]])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
    return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})


def _tiled(asks: DataFrame, asked: DataFrame, weight: DataFrame, sets: DataFrame, num: int, den: int, kind: str) -> DataFrame:
    """Documents (id) against all of a component (to), in tiles of TILE by TILE documents or less; tiles are dealt out in groups that are
    bounded by documents and by shingles. weight: (id, n)."""
    asks, asked = (stored(x.join(weight, "id"), "weighed") for x in (asks, asked))
    parts = lambda df, name: df.groupBy("to").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / (ROOM // 2))).cast("int").alias(name))
    cuts = stored(parts(asks, "nx").join(parts(asked, "ny"), "to"), "cuts")
    x = asks.join(cuts, "to").select("id", "n", "to", F.pmod(F.xxhash64("id"), "nx").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"), F.lit(True).alias("asks"))
    y = asked.join(cuts, "to").select("id", "n", "to", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(F.xxhash64("id"), "ny").alias("by"), F.lit(False).alias("asks"))
    return _dealt(x.union(y.select(x.columns)).select("id", "n", "asks", F.xxhash64("to", "bx", "by").alias("tile")), sets, num, den, kind)


def _crowded(rows: DataFrame, sets: DataFrame, num: int, den: int, kind: str) -> DataFrame:
    """Rows (key, id, n) of crowded entries: all documents of an entry against each other, by blocks."""
    homes = stored(rows.groupBy("id").agg(F.min("key").alias("home"), F.max("n").alias("n")), "homes")
    cuts = stored(homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / (ROOM // 2))).cast("int").alias("k")), "cuts")
    placed = stored(homes.join(cuts, "home").select("id", "n", F.xxhash64("home", F.pmod(F.xxhash64("id"), "k")).alias("block")), "placed")
    met = stored(rows.join(placed.select("id", "block"), "id").select("key", "block").distinct(), "met")
    meetings = stored(met.join(met.withColumnRenamed("block", "other"), "key").where("block <= other").select("block", "other").distinct(), "meetings")
    tile = F.xxhash64("block", "other").alias("tile")
    x = placed.join(meetings, "block").select("id", "n", F.lit(True).alias("asks"), tile)
    y = placed.withColumnRenamed("block", "other").join(meetings, "other").select("id", "n", F.lit(False).alias("asks"), tile)
    return _dealt(x.union(y), sets, num, den, kind)


def _dealt(tiles: DataFrame, sets: DataFrame, num: int, den: int, kind: str) -> DataFrame:
    """Rows (id, n, asks, tile) compared tile by tile, some tiles in one call."""
    rows = stored(tiles, "tiles")
    count, shingles = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, count // GROUP, shingles // ROOM)
    dealt = rows.join(sets, "id").select("tile", "asks", "id", "set", F.pmod("tile", F.lit(groups)).alias("g"))
    return stored(dealt.groupBy("g").applyInArrow(lambda t: _tile(t, num, den), f"a {kind}, b {kind}"), "more")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: str = "0.8", m: int = 14, r: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similarity: a decimal number, taken exactly."""
    with scratch() as keep:
        return keep(stored(_near_duplicates(docs, shingle, Fraction(similarity), m, r, id_col, text_col), "near-duplicates"))


def _near_duplicates(docs: DataFrame, shingle: int, least: Fraction, m: int, r: int, id_col: str, text_col: str) -> DataFrame:
    num, den = least.numerator, least.denominator
    linked = F.col("same") * F.lit(den) >= F.col("total") * F.lit(num)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(src.mapInArrow(lambda it: _sign(it, shingle, m, r), f"doc_id {kind}, n_shingles long, s1 long, s2 long, u array<long>"), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = F.min(F.struct("doc_id", "u")).alias("x")
    reps = stored(some.groupBy("s1", "s2", "n_shingles").agg(one).select(F.col("x.doc_id").alias("id"), "s1", "s2", F.col("n_shingles").alias("n"), F.col("x.u").alias("u")), "reps")

    # table entries that several classes share
    tables = F.expr(f"flatten(transform(sequence(0, {m - 2}), i -> transform(sequence(i + 1, {m - 1}), j -> xxhash64(i, j, u[i], u[j]))))")
    keys = reps.select("id", "n", F.explode(tables).alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"), "shared")
    entries = stored(keys.join(shared, "key"), "entries")
    discard(shared)
    ends = entries.select(F.col("lo").alias("a"), F.col("id").alias("b")).union(entries.select(F.col("hi").alias("a"), F.col("id").alias("b"))).where("a != b")
    pairs = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = lambda end: reps.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    fit = F.least("n_a", "n_b") * F.lit(den) >= F.greatest("n_a", "n_b") * F.lit(num)
    pairs = stored(pairs.join(sizes("a"), "a").join(sizes("b"), "b").where(fit).select("a", "b").distinct(), "pairs")

    wanted = stored(entries.select("id").distinct(), "wanted")
    sets = stored(src.join(_sent(wanted), F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(lambda it: _sets(it, shingle), f"id {kind}, set array<long>"), "sets")
    most = F.max(F.struct((F.col("same") / F.col("total")).alias("s"), "same", "total")).alias("x")
    known = stored(compared(pairs, sets).groupBy("a", "b").agg(most).select("a", "b", "x.same", "x.total"), "known")
    links = known.where(linked).select("a", "b")
    found = components(links)

    # entries with several components: what step 2 leaves open
    member = entries.join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = stored(member.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key"), "mixed")
    distance = known.select("a", "b", "same", (1 - F.col("same") / F.col("total")).alias("d"))
    to_lo = distance.select(F.col("a").alias("lo"), F.col("b").alias("id"), F.col("d").alias("d_lo"), F.col("same").alias("s_lo"))
    to_hi = distance.select(F.col("b").alias("hi"), F.col("a").alias("id"), F.col("d").alias("d_hi"))
    inner = member.join(mixed, "key").where("id != lo AND id != hi")
    inner = inner.join(to_lo, ["lo", "id"], "left").join(to_hi, ["hi", "id"], "left").select("key", "lo", "hi", "id", "n", "c", "d_lo", "s_lo", "d_hi")
    # an id of several texts has no single distance and no shingles of its own: bounds that rest on these don't hold for it
    several = stored(reps.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("several")), "several")
    loose = F.lit(False)
    if not several.isEmpty():
        for end in ("id", "lo", "hi"):
            inner = inner.join(several.select(F.col("id").alias(end), F.col("several").alias(f"loose_{end}")), end, "left")
        any_ = F.coalesce("loose_id", "loose_lo", "loose_hi").isNotNull()
        inner = inner.withColumns({c: F.when(~any_, F.col(c)) for c in ("d_lo", "s_lo", "d_hi")}).drop("loose_lo", "loose_hi")
        loose = F.coalesce("loose_id", F.lit(False))
    inner = stored(inner.drop("hi"), "inner")
    for _ in range(3):  # what the first round closes leaves more shingles alone
        open_ids = stored(inner.select("id").union(inner.select(F.col("lo").alias("id"))).distinct(), "ids")
        open_sets = sets.join(_sent(open_ids), "id", "left_semi")
        once = open_sets.select("id", F.explode("set").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("z")).where("id = z")
        alone = once.groupBy("id").agg(F.count("*").alias("alone"))
        left = F.col("n") - F.when(loose, F.lit(0)).otherwise(F.coalesce("alone", F.lit(0)))
        last, inner = inner, stored(inner.drop("e").join(alone, "id", "left").withColumn("e", left).drop("alone").where(F.col("e") * F.lit(den) >= F.col("n") * F.lit(num)), "inner")
        discard(last, open_ids)
    # a document of one component and a component that it meets in an entry: the smaller component asks
    size = stored(inner.select("id", "c").distinct().groupBy("c").agg(F.count("*").alias("size")), "size")
    inner = stored(inner.join(size, "c"), "open")
    crowd = stored(inner.where(f"size < {TILE}").groupBy("key").count().where(f"count > {CROWD}").select("key"), "crowd")
    crowded = not crowd.isEmpty()
    if crowded:
        inner = stored(inner.join(crowd.withColumn("crowd", F.lit(True)), "key", "left").withColumn("dense", F.col("crowd").isNotNull() & (F.col("size") < TILE)).drop("crowd"), "open")
    else:
        inner = inner.withColumn("dense", F.lit(False))

    def asking(where: str, rows: DataFrame, big: bool) -> DataFrame:
        """Documents and components that meet at `where` and may hold a link."""
        edges = [
            f(F.coalesce(d, F.lit(edge))).alias(name)
            for d, low, high in (("d_lo", "lo0", "lo1"), ("d_hi", "hi0", "hi1"))
            for f, edge, name in ((F.min, 0.0, low), (F.max, 1.0, high))
        ]
        ranges = stored(rows.where("NOT dense").where("size > 1" if big else "size = 1").groupBy(where, F.col("c").alias("to")).agg(
            F.max("size").alias("to_size"), F.min("n").alias("to_n"), F.max("n").alias("to_most"), F.max("e").alias("to_e"),
            F.max(F.coalesce("s_lo", "n")).alias("to_s"), F.max(F.col("e") - F.coalesce("s_lo", F.lit(0))).alias("to_v"), *edges,
        ), "ranges")
        far = F.lit(float(1 - least) + 1e-9)
        near = lambda d, low, high: F.col(d).isNull() | ((F.col(d) >= F.col(low) - far) & (F.col(d) <= F.col(high) + far))
        needed = (F.col("n") + F.col("to_n")) * F.lit(num)
        return rows.join(
            ranges,
            (rows[where] == ranges[where]) & (~F.col("dense") | (F.col("to_size") >= TILE)) & ((F.col("size") < F.col("to_size")) | ((F.col("size") == F.col("to_size")) & (F.col("c") > F.col("to"))))
            & (F.col("n") * F.lit(den) >= F.col("to_n") * F.lit(num)) & (F.col("to_most") * F.lit(den) >= F.col("n") * F.lit(num))
            & (F.least("e", "to_e") * F.lit(den + num) >= needed)
            # what both share with the smallest id, and what they may share beside it
            & (F.col("s_lo").isNull() | ((F.least("s_lo", "to_s") + F.least(F.col("e") - F.col("s_lo"), F.col("to_v"))) * F.lit(den + num) >= needed))
            & near("d_lo", "lo0", "lo1") & (F.lit(True) if big else near("d_hi", "hi0", "hi1")),
        ).select("id", "to")

    # with components of several, wherever both are known from the same smallest id: an entry's documents are, and it is asked once
    by_lo = inner.select("lo", "id", "n", "e", "c", "size", "d_lo", "s_lo", F.lit(None).cast("double").alias("d_hi"), "dense").distinct()
    asks = stored(asking("lo", by_lo, True).union(asking("key", inner.where("size = 1 AND NOT dense"), False)).distinct(), "asks")
    asked = inner.select("id", F.col("c").alias("to")).distinct().join(asks.select("to").distinct(), "to", "left_semi").select("id", "to")
    more = _tiled(asks, asked, reps.groupBy("id").agg(F.sum("n").alias("n")), sets, num, den, kind)
    if crowded:
        more = more.union(_crowded(inner.where("dense").select("key", "id", "n"), sets, num, den, kind))
    found = components(links.union(more))

    group = reps.join(found, "id", "left").select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("c"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id")
    own = signed.join(group, ["s1", "s2", "n_shingles"], "left").select("doc_id", "n_shingles", component)
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
