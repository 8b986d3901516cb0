"""Search by an index of blocks against a loop over all texts; case folding against Python's."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from gradewell.functions.canonical import FOLDS, folded
from gradewell.operators.tools import GRAM, rarest, search_index, search_matches

DAY = datetime.date(2024, 1, 1)


def corpus(rng):
    texts = ["".join(rng.choices("abAB ßé😀\n", k=rng.randint(0, 60))) for _ in range(150)] + [None, "", "x", "STRASSE ẞ ﬁx", "a" * 500, "ab" * 300]
    records = [(f"r{k % 140}", t, DAY + datetime.timedelta(days=rng.randint(0, 9))) for k, t in enumerate(texts)]  # some ids twice
    queries = [t[(a := rng.randint(0, len(t) - 1)) : a + n] for n in range(1, 30) for t in rng.choices([t for t in texts if t and len(t) > 30], k=3)]
    queries += ["", "zz", "a" * 40, "ab" * 20, "ba", "ss", "FIX", "x", "😀", "q" * 300]
    return records, [(f"c{k}", q, DAY + datetime.timedelta(days=rng.randint(0, 9)) if k % 3 else None, rng.choice([None, 1, 3, 10])) for k, q in enumerate(queries)]


def test_search(spark):
    records, calls = corpus(random.Random(4))
    got = search_matches(spark.createDataFrame(calls, "call_id string, query string, as_of_date date, `limit` int"), spark.createDataFrame(records, "record_id string, text string, observed_at date"))
    found = {}
    for r in got.collect():
        found.setdefault(r["call_id"], []).append((r["rank"], r["observed_at"], r["record_id"]))
    for call, query, day, limit in calls:
        hits = sorted(((d, i) for i, t, d in records if t is not None and query.casefold() in t.casefold() and (day is None or d <= day)), reverse=True)[: limit or 5]
        assert [(d, i) for _, d, i in sorted(found.get(call, []))] == hits, (call, query)


def test_index_holds_what_it_must(spark):
    """Each query's rarest grams are as many as its blocks are long, and its records are among theirs."""
    texts = [(str(k), "".join(random.Random(k).choices("abc", k=40))) for k in range(60)]
    queries = [t[k : k + n] for k, (_, t) in enumerate(texts[:20]) for n in (1, 2, 3, 7, 15, 16, 19)]
    asked, index = search_index(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(texts, "record_id string, text string"))
    best = rarest(asked, index)
    sizes = {r["query"]: r["n"] for r in best.groupBy("query").agg(F.max(F.length("gram")).alias("n")).collect()}
    assert sizes == {q: min(GRAM, (len(q) + 1) // 2) for q in queries}
    near = {(r["query"], r["record_id"]) for r in best.join(index, "gram").collect()}
    assert {(q, i) for q in queries for i, t in texts if q in t} <= near


def test_folding_is_pythons(spark):
    some = [*FOLDS, "straße STRASSE ẞ", "ΣΑΣ σας", "ﬃ", "İı", "漢字", "plain", "", "ŉ ǰ ΐ"]
    got = {r["t"]: r["f"] for r in spark.createDataFrame([(t,) for t in some], "t string").select("t", folded(F.col("t")).alias("f")).collect()}
    assert {t: f for t, f in got.items() if t in FOLDS} == FOLDS and got["straße STRASSE ẞ"] == "strasse strasse ss" and got["ﬃ"] == "ffi" and got["漢字"] == "漢字"
