"""The divergence audit against whole numbers of any size, and the tries against dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gradewell.llm import divergence
from gradewell.llm.divergence import Trie, count_terms, shares

FIND = re.compile(divergence.TERM)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, min_docs=3, top=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = FIND.findall(lowered(text))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of = {s: counts[lang, s] for x, s in groups if x == lang}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in of.items()}
        every = sum(of.values(), Counter())
        q = {t: 1 + 10**9 * (every[t] + 1) // (sum(every[x] for x in kept) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in of:
            pairs = [("pair", x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in of if x != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part in (pairs, terms):
                ranked = sorted(part, key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, k) for k, r in enumerate(ranked[: top if part is terms else None], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(rng, n):
    words = ["".join(rng.choice("aAbé漢zZ") for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["straße", "STRASSE", "x" * 300, "ﬁ", "😀"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", "1a2b_c", "\n.", "\x7f\x00"]), rng.choice(["en", "de", "de", None]), f"s{min(rng.randint(0, 5), rng.randint(0, 5))}") for _ in range(n)]
    return rows + [(None, "en", "s0"), ("", "fr", None), ("only once", "fr", "s1"), ("a " * 5000, None, ""), ("a a", "", None), ("12 34", "it", "s1"), ("12", "it", "s2")]


def test_brute_force(spark):
    """Nulls, empty texts, groups without terms, a language that keeps none, repeated rows, ties."""
    rows = corpus(random.Random(2), 300) * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert result(divergence.audit(df)) == brute(rows)
    assert result(divergence.audit(df, min_docs=1, top=3)) == brute(rows, 1, 3)


def test_cuts_change_nothing(spark, monkeypatch):
    rows = corpus(random.Random(3), 80)
    df = spark.createDataFrame([(t, l, s, 1, "x") for t, l, s in rows], "body string, language string, `from` string, value long, rank string").repartition(3)
    want = brute(rows)
    for cuts in ([], [b"a"], [b"a", b"aa", b"b", b"z", "é".encode()]):
        monkeypatch.setattr(divergence, "_cuts", lambda texts, cuts=cuts: cuts)
        assert result(divergence.audit(df, text_col="body", lang_col="language", source_col="from")) == want


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).isEmpty()
    assert result(divergence.audit(spark.createDataFrame([(None, None, None)] * 2, df.schema))) == []
    assert result(divergence.audit(spark.createDataFrame([(None, None, None), ("a", None, "b")], df.schema))) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abAé漢 1", max_size=12), st.integers(0, 2)), max_size=12), st.integers(1, 4))
def test_tries(texts, parts):
    """Counted in parts, written, read, cut and merged, tries hold what a dictionary holds."""
    want = Counter((w.encode(), g) for t, g in texts for w in FIND.findall(lowered(t)))
    docs = Counter((w.encode(), g) for t, g in texts for w in set(FIND.findall(lowered(t))))
    tries = []
    for k in range(parts):
        some = texts[k::parts]
        raw = [t.encode() for t, _ in some]
        trie = count_terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.array([g for _, g in some], np.int64))
        half = len(trie.terms) // 2
        tries += [Trie.load(x.dump()) for x in (trie.piece(0, half), trie.piece(half, len(trie.terms)))]
    t = Trie.merged(tries)
    assert t.terms == sorted(set(t.terms)) == sorted({w for w, _ in want})
    got = {(t.terms[a], b): (c, d) for a, b, c, d in zip(t.leaf.tolist(), t.group.tolist(), t.count.tolist(), t.docs.tolist(), strict=True)}
    assert got == {k: (n, docs[k]) for k, n in want.items()}


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randint(1, 9 * 10**15 // rng.choice([1, 10**3, 10**6, 10**12]))
        count = rng.randint(0, total - 1)
        assert shares(np.array([count]), total)[0] == 1 + 10**9 * (count + 1) // total


def test_long_runs():
    """Terms longer than what is hashed at once, next to each other in different texts."""
    raw = [b"ab" * 5000, b"ab" * 5000, b"ab" * 4999 + b"ac"]
    t = count_terms(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.zeros(3, np.int64))
    assert t.terms == [raw[0], raw[2]] and t.count.tolist() == [2, 1]
    assert Trie.load(t.dump()).terms == t.terms
