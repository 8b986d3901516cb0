"""Near duplicates among many documents that share a frame and are no near duplicates: entries that hold nearly all of them."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gradewell.llm import neardup
from gradewell.llm.common import scratch


def shingles(text, n=4):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def family(n, rng, frame=120, own=4):
    """A frame with words of each document's own; every eighth document is a near copy of another one."""
    base, texts = [f"f{k}" for k in range(frame)], []
    for i in range(n):
        x = list(base)
        for at in rng.sample(range(frame), own):
            x[at] = f"o{i}x{at}"
        if i % 8 == 7:
            x = texts[rng.randrange(len(texts))].split()
            x[rng.randrange(3)] = f"c{i}"
        texts.append(" ".join(x))
    return texts


def components_of(texts):
    sets, low = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = low[a], low[b]
            if x != y:
                low = [min(x, y) if k in (x, y) else k for k in low]
    return dict(enumerate(low))


@pytest.mark.parametrize(("crowd", "tile"), [(64, 256), (4, 16)])
def test_frames(spark, monkeypatch, crowd, tile):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "TILE", tile)
    called = []
    real = neardup._crowded
    monkeypatch.setattr(neardup, "_crowded", lambda *a: called.append(1) or real(*a))
    texts = family(420, random.Random(9)) + family(60, random.Random(10), frame=90, own=3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, shingle=4).collect()}
    wanted = components_of(texts)
    assert called and got == wanted and 100 < len(set(wanted.values())) < 450


def test_no_row_for_a_pair(spark):
    """Rows that are dealt out for tiles grow with the documents and the blocks, not with the pairs."""
    n = 3000
    with scratch():
        rows = spark.range(n).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("key"), "id", F.lit(10).cast("long").alias("n"))
        seen = []

        def dealt(tiles, *rest):
            seen.append(tiles.count())
            return tiles

        real, neardup._dealt = neardup._dealt, dealt
        try:
            neardup._crowded(rows, None, 4, 5, "long")
        finally:
            neardup._dealt = real
    blocks = -(-n // neardup.TILE)
    assert seen[0] <= 2 * (blocks + 1) / 2 * n * 1.2 < n * n / 100
