"""Stages on inputs that the other tests lack: several languages with a threshold that matters, copies, ids with several texts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradewell.llm import language, segmentation

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "etaoinshrdlu", "fr": "esaitnrulodé", "de": "enisratdhulß"}


@pytest.fixture(scope="module")
def mixed(spark):
    """Texts of three languages, texts of two mixed in all shares, one-letter texts, texts without letters."""
    rng = random.Random(12)
    text = lambda lang, n: " ".join("".join(rng.choices(LETTERS[lang], k=rng.randint(2, 8))) for _ in range(n))
    rows = [(text(lang, rng.randint(1, 60)), lang) for lang in LETTERS for _ in range(60)]
    rows += [(" ".join([text(a, rng.randint(1, 6)), text(b, rng.randint(1, 6))]), rng.choice([a, b, None])) for a in LETTERS for b in LETTERS if a != b for _ in range(15)]
    rows += [(c, None) for c in "etaß"] + [("12 34", "en"), ("", "de"), (None, "fr"), ("漢字", None)]
    return spark.createDataFrame([(k, t, lang, f"s{k % 3}", len(t or "")) for k, (t, lang) in enumerate(rows)], DOC).cache()


def test_language_stage(mixed):
    """Against counts and posteriors in plain numbers: what has no letter goes, and what no language has half of."""
    rows = mixed.collect()
    held = {r["doc_id"] for r in mixed.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held")).collect() if r["held"]}
    counts, docs = defaultdict(Counter), Counter()
    for r in rows:
        if r["lang"] and r["text"] is not None and r["doc_id"] not in held:
            counts[r["lang"]].update(language.grams(r["text"]).tolist())
            docs[r["lang"]] += 1
    langs, size = sorted(counts), 1 << language.BITS
    total = {lang: sum(counts[lang].values()) + size / 2 for lang in langs}
    wanted, shares = set(), []
    for r in rows:
        g = language.grams(r["text"] or "").tolist()
        if g:
            s = np.array([sum(np.log((counts[lang][x] + 0.5) / total[lang]) for x in g) + np.log(docs[lang] / sum(docs.values())) for lang in langs])
            p = np.exp((s - s.max()) / np.sqrt(len(g)))
            shares.append(p.max() / p.sum())
            if shares[-1] >= 0.5:
                wanted.add(r["doc_id"])
    got = {r["doc_id"] for r in corpus_pipeline.language_stage(mixed.sparkSession, mixed, "").collect()}
    near = sum(abs(s - 0.5) < 1e-4 for s in shares)
    assert got == wanted and not near and 3 < sum(s < 0.5 for s in shares) and len(langs) == 3


def test_copies_get_pieces_of_their_own(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(30))
    a, b, c = text(), text(), text()
    rows = [(1, a)] * 3 + [(2, b)] + [(1, c)] + [(None, b)] * 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    runs = [corpus_pipeline.pieces_stage(spark, docs.repartition(n), "") for n in (1, 4)]
    got = [sorted((str(r["doc_id"]), r["text"], r["pieces"]) for r in df.collect()) for df in runs]
    assert got[0] == got[1] and runs[0].columns == [*docs.columns, "pieces"]
    assert len({tuple(p) for i, t, p in got[0] if t == a}) == 3 and len({tuple(p) for i, t, p in got[0] if t == b}) == 3
    assert segmentation.decode(runs[0]).where("NOT (decoded <=> text)").isEmpty()
    first = {r["text"]: r["pieces"] for r in segmentation.encode(docs.dropDuplicates(["doc_id", "text"])).where("doc_id = 1").collect()}
    assert all(p in [x for i, t, x in got[0] if t == s] for s, p in first.items())  # the first copy is segmented as it is alone


def test_texts_of_one_id_all_stay(spark):
    rng = random.Random(6)
    text = lambda c: " ".join(f"{c}{rng.randrange(1000)}" for _ in range(40))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(1, a), (1, b), (1, b), (1, b + " end"), (2, c), (3, a + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    got = Counter((r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == {(3, "a"): 1, (1, "b"): 1, (2, "c"): 1}
