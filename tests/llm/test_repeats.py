"""Repeated passages against brute force: every position of every text."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradewell.llm import repeats
from gradewell.llm.queries import op11_repeats


def brute(rows, length):
    """(n_bytes, spans, kept) of each row."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - length + 1 if i is not None else 0):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        spans, k = [], 0
        while (k := gone.find(1, k)) >= 0:
            end = gone.find(0, k)
            spans.append((k, end if end >= 0 else len(b)))
            k = spans[-1][1]
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def found(df):
    return [(r["doc_id"], r["n_bytes"], [(s["begin"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("ab é漢") for _ in range(n))
    passage, text = prose(400), prose(300)
    out = [(k, prose(rng.randint(0, 300))) for k in range(1, 25)]
    out += [(k, prose(rng.randint(0, 90)) + passage[(a := rng.randint(0, 300)) : a + rng.randint(10, 120)] + prose(rng.randint(0, 90))) for k in range(30, 80)]  # parts of one passage, of all lengths
    out += [(k, text) for k in (90, 91, 89)] + [(92, text[:50]), (93, text[1:] + "b"), (94, text[:149] + "é" + text[150:])]  # copies, near copies
    out += [(100, "x" * 500), (99, "x" * 49), (101, "x" * 50), (102, "ab" * 300), (103, "b" + "ab" * 40), (104, "x" * 200 + passage)]  # runs and periods
    out += [(110, passage), (110, passage), (110, prose(80) + passage), (None, passage), (None, text), (111, None), (112, ""), (-5, passage[100:200]), (2**62, passage * 3)]  # repeated ids, none, negative, large
    out += [(120, "\0" * 60), (121, "a" + "\0" * 55)]  # what rows are filled up with
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("length", "gram", "wild", "hot"), [(50, 20, 16, 20000), (50, 20, 0, 20000), (50, 20, 2, 3), (50, 30, 16, 2), (24, 8, 1, 1), (64, 1, 16, 20000)])
def test_brute_force(spark, rows, length, gram, wild, hot):
    """However many phrases of a trigger are taken to be too many: none, some, all."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert same(found(repeats.remove_repeats(df, length=length, gram=gram, wild=wild, hot=hot)), brute(rows, length))


def test_chunks(spark, rows, monkeypatch):
    """Documents fall into chunks in any way."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    assert same(found(repeats.remove_repeats(df)), brute(rows, 50))


def test_long_texts(spark):
    """Longer than what is parsed at once: the passages lie across its borders."""
    rng = random.Random(7)
    noise = "".join(rng.choices("abcdefgh", k=repeats._SEGMENT + 5000))
    cut = repeats._SEGMENT
    out = {r[0]: r for r in found(repeats.remove_repeats(spark.createDataFrame([(1, noise), (2, noise[cut - 300 : cut + 300]), (3, "-" + noise)], "doc_id long, text string")))}
    assert out[1][2] == [] and out[2][2] == [(0, 600)] and out[3][2] == [(1, len(noise) + 1)] and out[3][3] == b"-"


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a" * 60, 1, 2, "z"), ("a" * 60, 2, 3, "z")], "body string, `Id` long, spans int, kept string")
    out = repeats.remove_repeats(df, id_col="Id", text_col="body")
    assert out.columns == ["Id", "n_bytes", "spans", "kept"] and {r["Id"]: len(r["kept"]) for r in out.collect()} == {1: 60, 2: 0}
    assert repeats.remove_repeats(df.where("false"), id_col="Id", text_col="body").isEmpty()
    with pytest.raises(ValueError):
        repeats.remove_repeats(df, id_col="Id", text_col="body", gram=50)


def test_order_of_phrases():
    """Both suffix arrays together: windows are equal where the classes are."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, before, after = 300, 4, 6
    wide = rng.integers(0, 2, (n, before + after)).astype(np.uint8)
    n_before, n_after, first = rng.integers(0, before + 1, n), rng.integers(2, after + 1, n), rng.integers(0, 40, n)
    b = wide[:, :before] * (np.arange(before) < n_before[:, None])
    a = wide[:, before:] * (np.arange(after) < n_after[:, None])
    mask = repeats.repeated_windows(b, a, n_before, n_after, first)
    windows = {(k, j): (bytes(b[j, :k]), bytes(a[j, : after - k])) for j in range(n) for k in range(before + 1) if k <= n_before[j] and after - k <= n_after[j]}
    low = {}
    for (k, j), w in windows.items():
        low[w] = min(first[j], low.get(w, first[j]))
    assert {x for x, w in windows.items() if low[w] < first[x[1]]} == {(k, j) for j in range(n) for k in range(before + 1) if mask[j] >> np.uint64(k) & np.uint64(1)}


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    out = op11_repeats(spark, str(tmp_path))
    assert same([tuple(r) for r in out.collect()], [(i, n, sum(e - b for b, e in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows, 50)])
