"""The operators for training text against brute force, on small tables with nulls, empty and odd texts, ties and repeated rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewell.llm import common, language, lines, mixing, neardup, quality, segmentation, token_counts, urls, vector_dedup, vector_search
from gradewell.llm.common import components, shared_dir
from gradewell.llm.pieces import model_path, parts_of, piece_table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = model_path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b", "a   b    c", "x\n\n y\n", "▁", "a▁▁b", "é́漢字ｱ😀", "a" * 3000, "abab" * 500, "\x01\x02 \x00", " \n ", "<s> x </s><unk>", "a\r\n\tb", "ﬁ Ａ", "word " * 20000]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def words(text):
    return (text or "").encode().lower().split()


def closed(ids, links):
    """The smallest id reachable."""
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def corpus(spark):
    """Random words; exact and near copies in chains; shared passages; odd rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [text(rng.randint(1, 120)) for _ in range(60)]
    passage = text(30)
    texts += [f"{text(20)} {passage} {text(20)}" for _ in range(20)]
    for k in range(12):  # chains: each a few words from the one before
        x = text(80).split()
        for _ in range(6):
            texts.append(" ".join(x))
            for _ in range(rng.randint(1, 3)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
    texts += [texts[3], texts[3].upper(), texts[5] + " ", "one two three", "one two", "one  two"]
    texts = ["\n".join(" ".join(x) for x in itertools.batched(t.split(" "), rng.randint(5, 30))) for t in texts]
    rows = [(i, t, None, f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate([*texts, *ODD])]
    rows += [(k, texts[85 + 6 * k] + " end", "en", "s0", 1) for k in range(1, 9)]  # ids of two texts
    rows += [(len(rows) + 100, None, None, "s0", None), (None, texts[0], None, "s1", 3), (None, None, None, None, None), rows[4], rows[4]]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "least"), [(4, "0.8"), (5, "0.8"), (2, "0.5")])
def test_near_duplicates(corpus, n, least):
    sets, num = defaultdict(list), Fraction(least)
    rows = corpus.select("doc_id", "text").collect()
    for r in rows:
        if r["doc_id"] is not None:
            sets[r["doc_id"]].append(shingles(r["text"], n))
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if any(x and y and len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b])]
    wanted = closed(sets, links)
    m = 14 if least == "0.8" else 60  # the tables are made for 0.8; a lower threshold needs more
    got = neardup.near_duplicates(corpus, shingle=n, similarity=least, m=m).collect()
    assert len(got) == len(rows) and len(links) > 25
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == wanted[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_near_duplicates_of_hot_groups(spark):
    """A large family in which some reach the first text only through others, and some reach nothing: the third step decides."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        x = list(base)
        for at in rng.sample(range(150), rng.choice([0, 1, 3, 4, 5, 6, 7, 9])):
            x[at] = f"u{i}x{at}"
        rows.append((i, " ".join(x)))
    for i in range(300, 330):
        rows.append((i, rows[i - 300][1] + f" end{i}"))
    sets = {i: shingles(t, 4) for i, t in rows}
    wanted = closed(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == wanted and 5 < len(set(wanted.values())) < 300


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((60, 40), (200, 230), (5, 0)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1000 + m)]
        wanted = closed({x for l in links for x in l}, links)
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {k: v for k, v in wanted.items() if any(k in l and l[0] != l[1] for l in links)}


def test_line_dedup_of_hot_keys(corpus, monkeypatch):
    """Keys that count as hot take the other way to the same lines."""
    monkeypatch.setattr(lines, "HOT", 4)
    monkeypatch.setattr(lines, "SAMPLED", 0.9)
    test_line_dedup(corpus)


def test_line_dedup(corpus):
    rows = corpus.select("doc_id", "text").distinct().collect()
    order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text"], k, tuple(w)) for r in rows for k, line in enumerate((r["text"] or "").split("\n")) if (w := line.encode().lower().split())]
    order.sort(key=lambda x: x[:2] + x[3:4])
    gone, seen, variants = defaultdict(set), set(), set()
    for known, doc, text, k, w in order:
        own = {(w[:t], w[t + d :]) for d in (0, 1) for t in range(len(w) + 1 - d)} if len(w) >= 5 else set()
        if w in seen or own & variants:
            gone[known, doc, text].add(k)
        seen.add(w)
        variants |= own
    wanted = Counter()
    for r in corpus.select("doc_id", "text").collect():
        drop = gone[r["doc_id"] is not None, r["doc_id"] or 0, r["text"]]
        wanted[r["doc_id"], None if r["text"] is None else "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in drop)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in lines.dedup_lines(corpus).collect()) == wanted and sum(map(len, gone.values())) > 20


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_one_edit_shares_coarse_and_fine_keys(data):
    """The two rounds of keys lose no pair of lines that are one word apart."""
    n = data.draw(st.integers(5, 80))
    a = data.draw(st.lists(st.integers(0, data.draw(st.sampled_from([1, 4, 500]))), min_size=n, max_size=n))
    at, edit = data.draw(st.integers(0, n - 1)), data.draw(st.sampled_from(["replace", "insert", "delete"]))
    b = [*a[:at], *([data.draw(st.integers(0, 500))] if edit != "delete" else []), *a[at + (edit != "insert") :]]
    if len(b) < 5:
        return
    hashes = np.random.default_rng(1).integers(0, 2**63, 501, dtype=np.uint64)
    s = lines.Sums(hashes[np.array(a + b)], np.array([len(a), len(b)]))
    line, key, i, j = lines.coarse(s, 5)
    assert set(key[line == 0]) & set(key[line == 1])
    fine = lambda x, begin, n: {int(k) for d in (0, 1) for k in s.key(np.full(n + 1 - d, x), begin + np.arange(n + 1 - d), begin + np.arange(n + 1 - d) + d, np.zeros(n + 1 - d, np.int64))}
    assert fine(0, 0, len(a)) & fine(1, len(a), len(b))
    assert lines.within_one([str(x).encode() for x in a], [str(x).encode() for x in b])


def test_within_one():
    w = str.split
    assert lines.within_one(w("a b c"), w("a b c")) and lines.within_one(w("a b"), w("a x b")) and lines.within_one(w("a b"), w("b")) and lines.within_one([], w("a"))
    assert not lines.within_one(w("a b"), w("b a")) and not lines.within_one(w("a b c"), w("x b y")) and not lines.within_one([], w("a b"))


def test_token_counts(corpus):
    sp = library()
    got = token_counts.token_counts(corpus)
    texts = [(r["doc_id"], r["text"] or "") for r in corpus.collect()]
    wanted = Counter((i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in texts)
    assert Counter(tuple(r) for r in got.collect()) == wanted


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab theinorc \n▁ßé漢😀-=/.0123"), max_size=120) | st.text(max_size=40))
def test_token_counts_of_any_text(text):
    table = piece_table(MODEL)
    parts = parts_of(text.replace("▁", " "))
    assert token_counts.merged_lengths(table, parts).sum() == len(library().encode(text))


def test_pieces_are_lossless_and_reproducible(corpus):
    coded = segmentation.encode(corpus).cache()
    back = segmentation.decode(coded)
    assert back.where("NOT (decoded <=> text)").isEmpty() and back.where("text = '' AND size(pieces) <> 0").isEmpty()
    again = segmentation.encode(corpus.repartition(7, "n_chars"))
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "pieces").collect()))
    assert key(again) == key(coded)
    assert key(segmentation.encode(corpus, seed=18)) != key(coded)
    clash = corpus.withColumn("pieces", F.lit("mine")).withColumn("decoded", F.lit(1))
    assert segmentation.decode(segmentation.encode(clash)).schema["decoded"].dataType.simpleString() == "string"


def test_sampling_follows_the_lattice():
    """All ways to write a word come up as often as their weights say."""
    table = piece_table(MODEL)
    lat = segmentation.Lattices(table, 1.0)
    word = " these"
    ids, n = segmentation.draw(lat, [[word]] * 20000, np.arange(20000, dtype=np.uint64) * np.uint64(77777))
    seen = Counter(tuple(x) for x in np.split(ids, np.cumsum(n)[:-1]))

    def ways(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if (i := table.id_of.get(rest[:k])) is not None:
                for more, w in ways(rest[k:]):
                    yield (i, *more), w + lat.logp[i]

    weights = {p: math.exp(w) for p, w in ways(word)}
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for p, w in weights.items():
        share = w / total
        assert abs(seen[p] / 20000 - share) < 4 * math.sqrt(share * (1 - share) / 20000) + 1e-4


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(p), p, v) for p, v in rules if (host == p[: p.index("/")] or host.endswith("." + p[: p.index("/")])) and path.startswith(p[p.index("/") :])]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_urls(spark):
    given_ = ["http://a.example.com/en/x?q#f", "https://WWW.Example.COM/en/1", "http://example.com/fr", "http://x.net/es/1", "http://net/fr/", "http://planet/es/", "http://x.com", "http://x.com?a/b", "no scheme", "", None, "a://b://c/d", "http://casinopoker.example.org/en/1", "http://weather.example.org/de/2", "http://ÄB.com/", "http://" + "a" * 5000 + ".org/"]
    pages = spark.createDataFrame([(i, u, "<p>" + "the weather report " * 500 + "</p>") for i, u in enumerate(given_)] + [(None, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, u in enumerate(given_):
        host, path, rule, verdict = brute_url(u, urls.RULES)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])
    assert urls.Words({"weather": 5, "report": 4}).split("weatherreport") == ["weather", "report"]
    assert urls.judge(pages.limit(0)).isEmpty()
    none = urls.judge(pages.where("url IS NULL OR url NOT LIKE '%://%'")).collect()
    assert {(r["host"], r["path"], r["rule"], r["verdict"], r["block_odds"]) for r in none} == {("", "", None, "allow", 0.0)}


def brute_odds(urls_, counts):
    """Log odds of `block`, of urls: the likeliest of all ways to cut every part, then a multinomial naive Bayes of the urls with rules."""
    whole = sum(counts.values()) + len(counts) + 1
    cost = lambda w: math.log((counts[w] + 1) / whole) if w in counts else math.log(1 / whole) - 2.3 * len(w)

    def cut(part):
        best = {0: (0.0, [])}
        for j in range(1, len(part) + 1):
            best[j] = max(((best[i][0] + cost(part[i:j]), [*best[i][1], part[i:j]]) for i in range(j)), key=lambda x: x[0])
        return best[len(part)][1]

    def tokens(host, path):
        return [w for x in (host, path.lower()) for part in re.findall(r"[^\W\d_]+", x) for w in cut(part)]

    of, n = {"allow": Counter(), "block": Counter()}, Counter()
    for url in urls_:
        host, path, rule, verdict = brute_url(url, urls.RULES)
        if rule:
            at = rule.index("/")
            of[verdict].update(tokens(host.removesuffix(rule[:at]), path.removeprefix(rule[at:])))
            n[verdict] += 1
    seen = len(of["allow"] | of["block"])
    logp = lambda w, v: math.log((of[v][w] + 1) / (sum(of[v].values()) + max(seen, 1)))
    prior = math.log((n["block"] + 1) / (n["allow"] + 1))
    return [prior + (sum(logp(w, "block") - logp(w, "allow") for w in tokens(*brute_url(url, urls.RULES)[:2])) if n else 0.0) for url in urls_]


def test_url_model_has_every_word(spark):
    """Odds against brute force; words that are sent to all, and words that only reach the urls that need them, give the same."""
    rng = random.Random(11)
    common = ["".join(c) for c in itertools.islice(itertools.product("abcdefghij", repeat=4), 5_000)]
    rare = ["enbetest", "dietestein", *("".join(rng.choice("klmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(60))]
    text = [" ".join(common), " ".join(common), "en est ein " * 2000, " ".join(rare)]
    ends = [".org/", ".com/", "example.com/en/", ".net/es/", ".net/fr/", ".net/de/", ".example.com/en/"]
    name = lambda some: rng.choice(some) + rng.choice([*common[:50], *rare])
    given_ = ["http://enbetest.org/", "http://dietestein.org/", None, "none", "http:///es/", *(f"http://{name(rare[k % 2 * 30 :][:30])}{(end := rng.choice(ends))}{rng.choice(rare)}/{rng.choice(common)}" for k in range(60))]
    pages = spark.createDataFrame([(i, u, text[i] if i < len(text) else None, 1) for i, u in enumerate(given_)] * 2, "page_id long, url string, html string, own int")
    counts = Counter({w: 2 * n for w, n in Counter(" ".join(text).split()).items()})
    want = sorted([*enumerate(brute_odds(given_ * 2, counts)[: len(given_)])] * 2)
    assert urls.Words(counts).tokens("enbetest.dietestein", "") == ["enbetest", "dietestein"]
    ruled = [brute_url(u, urls.RULES)[3] for u in given_]
    assert {x > 0 for (_, x), v in zip(want[::2], ruled, strict=True) if v is None} == {True, False} and set(ruled) == {"allow", "block", None}
    for few in ({}, {"vocabulary": 40}, {"vocabulary": 1}, {"vocabulary": 0}):
        got = sorted(urls.judge(pages, **few).collect(), key=lambda r: r["page_id"])
        for r, (i, odds) in zip(got, want, strict=True):
            assert r["page_id"] == i and math.isclose(r["block_odds"], odds, abs_tol=1e-9)
            assert r["verdict"] == (ruled[i] or ("block" if odds > 0 else "allow"))


def test_url_words_of_any_length(spark):
    long = "donaudampfschifffahrtscasinobetgesellschaft"
    given_ = [f"http://{long}.org/", f"http://x.org/{long}{long}", "http://" + "q" * 60 + ".org/", f"http://{long}.net/es/", "http://donau.com/schifffahrt"]
    text = [f"{long} " * 50 + "donau dampf schifffahrt gesellschaft", "x org", None, None, None]
    pages = spark.createDataFrame(list(zip(range(5), given_, text, strict=True)), "page_id long, url string, html string")
    counts = Counter({w: n for w, n in Counter(" ".join(filter(None, text)).split()).items() if len(w) > 1})
    model = urls.Words(counts)
    assert model.split(long) == [long] and model.split(long * 2) == [long] * 2 and model.split("q" * 60) == ["q" * 60]
    want = brute_odds(given_, counts)
    for few in ({}, {"vocabulary": 0}):
        got = {r["page_id"]: r for r in urls.judge(pages, **few).collect()}
        assert all(math.isclose(got[i]["block_odds"], want[i], abs_tol=1e-9) for i in range(5)) and got[0]["verdict"] == "block" and got[3]["verdict"] == "block"


def test_url_split_is_the_likeliest():
    rng = random.Random(4)
    text = lambda most: "".join(rng.choice("abe") for _ in range(rng.randint(1, most)))
    for _ in range(100):
        model = urls.Words({text(rng.choice([3, 40])): rng.randint(1, 1000) for _ in range(rng.randint(0, 30))})
        cost = lambda w: model.logp[w] if w in model.logp else model.unknown - 2.3 * len(w)  # noqa: B023, E731
        name = "".join(rng.choice([*model.logp, text(30)]) for _ in range(rng.randint(1, 4)))
        best = [0.0]
        for j in range(1, len(name) + 1):
            best.append(max(best[i] + cost(name[i:j]) for i in range(j)))
        out = model.split(name)
        assert "".join(out) == name and math.isclose(sum(map(cost, out)), best[-1])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    letters = {"en": "etaoin shrdlu", "xx": "zyxwvu qjkbpg", "ру": "аеоинт срвлкм"}
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(list(letters))
        good = rng.random() < 0.8
        text = " ".join("".join(rng.choice(letters[lang].replace(" ", "")) for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), lang if i % 10 else None, "s", len(text)))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None, None, 0), (1001, "", "en", None, 0), (1002, "12 34 !!", "en", None, 0), (1003, "eta " * 60000, "en", None, 0), (None, "eta shr", None, None, 0)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_language(labelled):
    docs, _ = labelled
    got = {r["doc_id"]: r for r in language.identify(docs.drop("lang"), language.train(docs)).join(docs.select(F.col("doc_id").alias("i"), "lang"), F.col("i") == F.col("doc_id"), "left").collect()}
    known = [r for r in got.values() if r["lang"] and r["doc_id"] < 600]
    assert sum(r["lang"] == r["lang_pred"] for r in known) > 0.99 * len(known)
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "en"]
    assert {r["lang_pred"] for r in language.identify(docs.limit(0).union(docs.limit(3)), ([], np.zeros((1, 0)))).collect()} == {"und"}
    held = docs.where("crc32(cast(doc_id as string)) % 4 = 2").select("doc_id").collect()
    changed = docs.withColumn("lang", F.when(F.col("doc_id").isin([r[0] for r in held]), "zz").otherwise(F.col("lang")))
    assert (language.train(changed)[1] == language.train(docs)[1]).all() and language.train(changed)[0] == ["en", "xx", "ру"]


def test_language_learns_from_every_row(spark):
    ids = spark.range(30_000).where("crc32(cast(id AS string)) % 4 <> 2").orderBy(F.xxhash64("id").desc())
    assert ids.count() > 20_000
    rare = [r["id"] for r in ids.limit(2).collect()]
    text = F.when(F.col("id") == rare[0], "zyx wvu zyx").when(F.col("id") == rare[1], "12").otherwise(F.concat(F.lit("eta "), F.expr("substr('abcdefghij', 1 + id % 10, 1)")))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") == rare[0], "xx").when(F.col("id") == rare[1], "nn").otherwise("en").alias("lang"))
    counts = {x: np.full(1 << language.BITS, 0.5) for x in ("en", "nn", "xx")}
    for r in docs.where("crc32(cast(doc_id AS string)) % 4 <> 2").collect():
        np.add.at(counts[r["lang"]], language.grams(r["text"]), 1)
    langs, logp = language.train(docs)
    assert langs == ["en", "nn", "xx"] and np.allclose(logp, np.stack([np.log(counts[x] / counts[x].sum()) for x in langs], 1), atol=1e-5)
    got = language.identify(spark.createDataFrame([(1, "zyx wvu")], "doc_id long, text string"), (langs, logp)).first()
    assert got["lang_pred"] == "xx"


def test_quality(labelled, spark):
    docs, labels = labelled
    got = {r["doc_id"]: r["quality_score"] for r in quality.classify(docs.drop("lang"), labels).collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").collect()]
    assert sum((got[i] >= 0.7) == bool(q) for i, q in known) > 0.98 * len(known)
    assert all(0 <= s <= 1 for s in got.values()) and 0.7 < got[1000] < 0.9 and got[1000] == got[1001]
    one = labels.where("quality = 1")
    assert {r["quality_score"] for r in quality.classify(docs.limit(5), one).collect()} == {1.0}
    assert {r["quality_score"] for r in quality.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 6))
    x = np.vstack([x, x[:40] + 0.05 * rng.standard_normal((40, 6)), x[:10], 3 * x[:5], np.zeros((1, 6))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [1.0] * 5 + [float("nan")]), (503, [1.0] * 5 + [None]), (504, [1.0] * 5 + [float("inf")]), (505, [1.0, 2.0]), (506, [1.0, 2.1]), (None, [1.0] * 6), (507, [1e30] * 6), (508, [1e30] * 6)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_vector_duplicates(spark):
    df, rows = vectors(spark)
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and usable(v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] / np.linalg.norm(good[a]) @ (good[b] / np.linalg.norm(good[b])) >= 0.95]
    n, wanted = Counter(x for l in links for x in l), closed({i for i, _ in rows if i is not None}, links)
    got = vector_dedup.vector_duplicates(df).collect()
    assert len(got) == len(rows) and len(links) > 50
    for r in got:
        assert r["n_links"] == n[r["vec_id"]] and r["component_id"] == wanted.get(r["vec_id"]) and r["kept"] == (r["vec_id"] == r["component_id"] or r["vec_id"] is None)
    assert vector_dedup.vector_duplicates(df.limit(0)).isEmpty()


def test_tiles_and_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr("gradewell.llm.vectors.BLOCK", 16)
    test_vector_duplicates(spark)


@pytest.mark.parametrize("block", [4096, 16])
def test_vector_search(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr("gradewell.llm.vectors.BLOCK", block)
    df, rows = vectors(spark)
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and usable(v) and max(map(abs, v)) < 1e20}
    wanted = set()
    for q in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], good[i], strict=True)), i) for i in good if i != q and len(good[i]) == len(good[q]))
            wanted |= {(q, k, i, -s) for k, (s, i) in enumerate(scored[:7], 1)}
    small = df.where("vec_id IS NULL OR vec_id NOT IN (507, 508)")
    assert {tuple(r) for r in vector_search.top_k(small, F.col("vec_id") % 20 == 0, k=7).collect()} == wanted
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_mixing(corpus, spark):
    got = mixing.mix_plan(corpus).collect()
    size, order = Counter(), sorted({r["source"] for r in corpus.collect()}, key=lambda s: (s is None, s or ""))
    for r in corpus.collect():
        size[r["source"]] += len(words(r["text"]))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, Fraction(3, 2) * sum(size.values()), set(order)
    while open_:  # share out; who is above the stop gets the stop, the rest is shared again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = Fraction(2 * size[s]) if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]])
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (math.floor(rate), math.ceil(rate)) and r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(map(str, mixing.mix_plan(corpus.repartition(5)).collect())) == sorted(map(str, got))
    assert mixing.mix_sources(corpus).count() == sum(r["copies"] for r in got)
    assert mixing.mix_plan(corpus.limit(0)).isEmpty()
    many = spark.range(20000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', cast(id % 50 as int)) AS text")
    for r in mixing.mix_plan(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r["taken"] / r["target"] - 1) < 0.02


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    assert neardup.near_duplicates(docs).isEmpty() and lines.dedup_lines(docs).isEmpty() and token_counts.token_counts(docs).isEmpty()
    assert segmentation.decode(segmentation.encode(docs)).isEmpty() and language.identify(docs).isEmpty()
    assert quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).isEmpty()


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_pipeline(spark, corpus, labelled, tmp_path):
    import corpus_pipeline

    docs = corpus.withColumn("lang", F.lit("en")).union(labelled[0])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        tables.append(kept)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(tables[-1])
    first, second, third, mixed, coded = tables
    assert first.where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").isEmpty() and first.count() > 0.9 * docs.where("text RLIKE '\\\\p{L}'").count()
    assert second.where("n_chars <> length(text)").isEmpty()
    texts = {r["doc_id"]: shingles(r["text"], 5) for r in third.collect() if r["doc_id"] is not None}
    assert not [1 for a, b in itertools.combinations(texts, 2) if texts[a] and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
    assert third.groupBy("doc_id", "text").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty()
    assert segmentation.decode(coded).where("NOT (decoded <=> text)").isEmpty() and coded.count() == mixed.count()


def test_near_duplicate_stage_of_odd_ids(spark):
    """Repeated and null ids: what goes is near to what stays, or has its id and text; the same rows stay however they are dealt out."""
    import corpus_pipeline

    rng = random.Random(8)
    text = {c: " ".join(f"{c}{rng.randrange(1000)}" for _ in range(60)) for c in "abcdefgh"}
    near = {c: t + " end" for c, t in text.items()}
    rows = [(1, text["a"]), (1, text["b"]), (2, near["b"]), (3, near["a"]), (None, text["c"]), (None, text["c"]), (None, near["c"]), (4, text["d"]), (None, near["d"]), (5, text["e"]), (5, text["e"]), (6, text["f"]), (6, text["g"]), (7, near["h"]), (7, near["a"]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for k, (i, t) in enumerate(rows) for lang in ("en", "de")[: 1 + (k > 8)]], DOC)
    runs = [sorted(map(tuple, corpus_pipeline.near_duplicate_stage(spark, docs.repartition(n, "lang") if n == 2 else docs.repartition(n), "").collect()), key=str) for n in (1, 2, 5)]
    got = Counter((i, t) for i, t, *_ in runs[0])
    assert runs[0] == runs[1] == runs[2] and max(got.values()) == 1
    assert {t[0] for _, t in got if t} == set("abcdefgh")
    assert Counter(i for i, _ in got if i is not None) == {2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 1}
    assert sum(i is None and bool(t) for i, t in got) == 1 and {t for i, t in got if i is None} >= {None, ""}


def test_pipeline_stages_against_brute_force(spark, corpus):
    """Each stage drops what its rule drops, and nothing else, of documents with ids of their own."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame([(*r[:2], "en", *r[3:]) for r in {r["doc_id"]: r for r in corpus.collect() if r["doc_id"] is not None}.values()], DOC).cache()
    rows, pairs = docs.collect(), lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    known = {r["doc_id"]: r["text"] or "" for r in rows}

    assert pairs(stage["language"](spark, docs, "")) == Counter((r["doc_id"], r["text"]) for r in rows if any(map(str.isalpha, r["text"] or "")))

    seen, variants, wanted = set(), set(), Counter()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        left = []
        for line in (r["text"] or "").split("\n"):
            w = tuple(line.encode().lower().split())
            own = {(w[:t], w[t + d :]) for d in (0, 1) for t in range(len(w) + 1 - d)} if len(w) >= 5 else set()
            if not w or not (w in seen or own & variants):
                left.append(line)
            seen.add(w)
            variants |= own
        text = None if r["text"] is None else "\n".join(left)
        if len(left) == len((r["text"] or "").split("\n")) or (text or "").encode().split():
            wanted[r["doc_id"], text] += 1
    assert pairs(stage["lines"](spark, docs, "")) == wanted

    sets = {i: shingles(t, 5) for i, t in known.items()}
    low = closed(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert pairs(stage["near_duplicates"](spark, docs, "")) == Counter((r["doc_id"], r["text"]) for r in rows if low[r["doc_id"]] == r["doc_id"])

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()}
    mixed = stage["mixing"](spark, docs, "")
    assert pairs(mixed) == Counter({(r["doc_id"], r["text"]): copies[r["doc_id"]] for r in rows if copies[r["doc_id"]]})
    assert pairs(stage["pieces"](spark, docs, "")) == pairs(docs)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_search_of_any_finite_size(spark, kind):
    """Scores beyond a long are the nearest long; bounds that overflow lose nothing."""
    rng = np.random.default_rng(9)
    top = 3e38 if kind == "float" else 1.7e308
    rows = [(i, (rng.standard_normal(4) * 10.0 ** rng.integers(-1, 40 if kind == "double" else 30)).tolist()) for i in range(120)]
    rows += [(200, [top] * 4), (220, [-top, top, 0.0, 0.0]), (240, [1e30] * 4), (241, [-1e30] * 4), (242, [0.0] * 4), (243, [1e30] * 4)]
    rows = [(i, np.asarray(v, np.float32 if kind == "float" else np.float64).tolist()) for i, v in rows]
    whole = {i: [int(x) for x in vector_search.scaled(np.array(v), 64.0)] for i, v in rows}
    wanted = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), -(2**63)), 2**63 - 1), i) for i in whole if i != q)
            wanted |= {(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)}
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert {tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect()} == wanted


def thue_morse(a, b, n):
    """The word of n letters in Thue-Morse order, and its complement: sums of powers modulo 2^64 can't tell them apart."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


@pytest.mark.parametrize("n", [1024, 2048])
def test_texts_that_sums_of_powers_confuse(spark, n):
    """Different lines stay, different words link nothing, however they are built."""
    x, y = (" ".join(w) for w in thue_morse("alpha", "beta", n))
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")).collect()}
    assert got == {1: (0, x), 2: (0, y), 3: (1, "")}
    x, y = ("".join(w) for w in thue_morse("a", "b", n))
    texts = [f"{x} p q r s", f"{y} p q r s", f"{x} p q r s", x, y, f"{x} {y}", f"{y} {x}"]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=70), max_size=30))
def test_hashes_are_of_the_bytes(parts):
    raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts], dtype=np.int64)
    got = common.hashes(raw, ends - np.array([len(x) for x in parts], np.int64), ends)
    assert len(set(got.tolist())) == len(set(parts)) and len(set(zip(parts, got.tolist(), strict=True))) == len(set(parts))


def test_long_runs_without_spaces():
    rng = random.Random(6)
    table, sp = piece_table(MODEL), library()
    for letters in ("etaoinshrdlu", "aB3+/xQ9z", "".join(map(chr, range(0x4E00, 0x4F00))), "ab"):
        text = "".join(rng.choice(letters) for _ in range(60_000))
        begun = time.monotonic()
        assert token_counts.merged_lengths(table, parts_of(text)).sum() == len(sp.encode(text))
        assert time.monotonic() - begun < 20


def test_language_against_brute_force(labelled):
    """Multinomial naive Bayes with priors, text by text and gram by gram."""
    docs, _ = labelled
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("lang") == "en", "en"))  # uneven priors
    docs = docs.union(docs.where("doc_id = 7"))
    rows = docs.collect()
    counts, n = defaultdict(Counter), Counter()
    for r in docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2").collect():
        counts[r["lang"]].update(language.grams(r["text"]).tolist())
        n[r["lang"]] += 1
    assert max(n.values()) > 1.5 * min(n.values())
    wanted, total = Counter(), {x: c.total() for x, c in counts.items()}
    for r in rows:
        g = Counter(language.grams(r["text"] or "").tolist())
        if not g:
            wanted[r["doc_id"], "und", 0.0] += 1
            continue
        s = {x: math.log(n[x] / sum(n.values())) + math.fsum(many * math.log((counts[x][k] + 0.5) / (total[x] + 0.5 * 2**language.BITS)) for k, many in g.items()) for x in sorted(n)}
        top = max(s, key=s.get)
        wanted[r["doc_id"], top, round(1 / sum(math.exp((v - s[top]) / math.sqrt(g.total())) for v in s.values()), 3)] += 1
    got = Counter((r["doc_id"], r["lang_pred"], round(r["lang_score"], 3)) for r in language.identify(docs, language.train(docs)).collect())
    assert got == wanted


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(k, "abc abd", lang) for k in range(40) for lang in ("b", "a")], "doc_id long, text string, lang string")
    got = language.identify(docs, language.train(docs)).collect()
    assert {(r["lang_pred"], r["lang_score"]) for r in got} == {("a", 0.5)}


def test_quality_against_brute_force(labelled):
    """All cosines with all labelled rows, sorted; nothing of a held-out label is learned."""
    docs, labels = labelled
    model = quality.train(docs, labels)
    k, seen = 15, quality.Features()
    got = {r["doc_id"]: r["quality_score"] for r in quality.classify(docs, labels, k=k).where("doc_id < 600").collect()}
    for r in docs.where("doc_id < 600").collect():
        x = quality.weigh(seen.counts(r["text"])[None], model["idf"]) @ model["v"]
        cos = ((x / np.linalg.norm(x)) @ model["z"].T)[0].astype(np.float64)
        near = sorted(range(len(cos)), key=lambda j: (-cos[j], j))[:k]
        votes = [max(cos[j], 1e-6) ** 4 * model["vote"][j] for j in near]
        want = sum(v for v, j in zip(votes, near, strict=True) if model["y"][j] == 1) / sum(votes)
        assert math.isclose(got[r["doc_id"]], want, abs_tol=2e-3)
    held = F.expr("crc32(cast(doc_id AS string)) % 4 = 2")
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["quality_score"] for r in quality.classify(docs, other, k=k).where("doc_id < 600").collect()} == got


def test_nearest_breaks_ties_by_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        cos = rng.integers(0, 4, (6, 600)).astype(np.float32)
        k = int(rng.integers(1, 40))
        for row, near in zip(cos, quality.nearest(cos, k), strict=True):
            assert sorted(near.tolist()) == sorted(sorted(range(600), key=lambda j: (-row[j], j))[:k])
    assert quality.nearest(np.ones((2, 3), np.float32), 15).tolist() == [[0, 1, 2]] * 2


def test_quality_of_repeated_ids_and_a_bounded_sample(labelled, spark):
    docs, labels = labelled
    hot = docs.union(spark.range(3000).selectExpr("7L AS doc_id", "concat('eta shr ', id % 50) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars"))
    model = quality.train(hot, labels.union(labels), sample=40)
    assert len(model["y"]) == 80 and sorted(Counter(model["y"].tolist()).values()) == [40, 40]
    a, b = (quality.train(x, labels) for x in (hot, hot.repartition(7, "text")))
    assert (a["y"] == b["y"]).all() and np.allclose(a["idf"], b["idf"])


#: Names that operators use themselves, for columns that are none of their business.
NAMES = ("__source", "__id", "__doc", "__rk", "__text", "__lines", "__key", "row", "id", "key", "rank", "of", "h", "size", "source_size", "target", "rate", "copies", "taken", "lang_pred", "lang_score",
         "quality_score", "n_lines", "n_dropped", "has_text", "doc_of", "rk_of", "lines_of", "text_of", "source_of", "source_of_0", "copy", "n_shingles", "component_id", "kept", "Doc", "block_odds", "v", "vec", "cell", "block", "n", "own", "url_", "count", "hash")


def clashing(df):
    return df.select("*", *[F.lit(f"my {c}").alias(c) for c in NAMES if c.lower() not in {x.lower() for x in df.columns}])


def test_clashing_names(spark, corpus, labelled):
    """Columns of any names change nothing; where a docstring doesn't say that one is replaced, it comes out as it went in."""
    docs, labels = labelled
    small = corpus.where("doc_id < 60")
    rows = lambda df, *columns: Counter(map(str, df.select(*columns).collect()))
    for f, df, columns in (
        (lambda d: neardup.near_duplicates(d, shingle=4), small, ("doc_id", "n_shingles", "component_id", "kept")), (lines.dedup_lines, small, ("doc_id", "text", "n_lines", "n_dropped", "has_text")),
        (token_counts.token_counts, small, ("doc_id", "n_tokens")), (segmentation.encode, small, ("doc_id", "text", "pieces")), (lambda d: segmentation.decode(segmentation.encode(d)), small, ("doc_id", "decoded")),
        (lambda d: quality.classify(d, clashing(labels)), docs, ("doc_id", "quality_score")), (lambda d: language.identify(d, language.train(d)), docs, ("doc_id", "lang_pred", "lang_score")),
        (mixing.mix_plan, small, ("doc_id", "size", "source_size", "target", "taken")), (mixing.mix_sources, small, ("doc_id", "text", "source")),
        (lambda d: vector_dedup.vector_duplicates(d), vectors(spark)[0], ("vec_id", "n_links", "component_id", "kept")), (lambda d: vector_search.top_k(d, F.col("vec_id") % 20 == 0), vectors(spark)[0], ("query_id", "rank", "vec_id", "score")),
        (urls.judge, spark.createDataFrame([(1, "http://a.net/es/x", "<p>a x</p>"), (2, "http://ax.org/", "b"), (2, None, None)], "page_id long, url string, html string"), ("page_id", "host", "path", "rule", "verdict", "block_odds")),
    ):
        assert rows(f(clashing(df)), *columns) == rows(f(df), *columns)
    for f, replaced in ((lines.dedup_lines, {"n_lines", "n_dropped", "has_text"}), (segmentation.encode, set()), (mixing.mix_sources, set()), (lambda d: language.identify(d, language.train(d)), {"lang_pred", "lang_score"}), (lambda d: quality.classify(d, labels), {"quality_score"})):
        got = f(clashing(docs.limit(5)))
        mine = [c for c in NAMES if c not in replaced]
        assert {tuple(r) for r in got.select(*mine).collect()} == {tuple(f"my {c}" for c in mine)}


def test_pipeline_of_clashing_names(spark, corpus):
    import corpus_pipeline

    docs = corpus.where("doc_id < 40").withColumn("lang", F.lit("en")).cache()
    for name, stage in corpus_pipeline.STAGES:
        for given_ in (docs, docs.dropDuplicates(["doc_id"])) if name == "near_duplicates" else (docs,):
            plain, got = stage(spark, given_, ""), stage(spark, clashing(given_), "").cache()
            mine = [c for c in NAMES if c.lower() not in {x.lower() for x in given_.columns}]
            assert {tuple(r) for r in got.select(*mine).collect()} == {tuple(f"my {c}" for c in mine)}, name
            assert Counter(map(str, got.select(plain.columns).collect())) == Counter(map(str, plain.collect())), name
        assert stage(spark, docs.limit(0), "").isEmpty()


def test_tables_go(spark, corpus):
    """What operators store is deleted, also if one fails; a result stays till the block around it ends."""
    import os

    here = lambda: {x for x in os.listdir(shared_dir(spark)) if x.startswith("gradewell-")}
    before = here()
    with common.scratch():
        got = neardup.near_duplicates(corpus)
        lines.dedup_lines(corpus).count()
        vector_search.top_k(vectors(spark)[0], F.col("vec_id") % 20 == 0).count()
        assert got.count() == corpus.count() and len(here() - before) == 3
    assert here() == before
    broken = corpus.withColumn("text", F.when(F.col("doc_id") == 3, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        lines.dedup_lines(broken)
    assert here() == before
