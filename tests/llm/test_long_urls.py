"""Urls with parts of a hundred thousand letters, where words are joined with parts and where they are sent."""

from __future__ import annotations

import random

from gradewell.llm import urls


def test_long_parts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    long = "".join(rng.choice(words) for _ in range(30_000))[:100_000]
    many = "".join(f"{w}1" for w in rng.choices(words, k=20_000))
    found = ["http://" + long + ".com/x", "https://a.net/fr/" + long[:50_000], "https://a.org/" + many, "https://b.org/" + long[::-1], *(f"https://{rng.choice(words)}{rng.choice(words)}.{rng.choice(['com/a', 'net/es/b', 'org/c'])}" for _ in range(40))]
    pages = [(k, u, "<p>" + " ".join(rng.choices(words, k=30)) + "</p>") for k, u in enumerate(found)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    joined, sent = ({r["page_id"]: tuple(r) for r in urls.judge(df, vocabulary=v).collect()} for v in (0, 50_000))
    assert len(joined) == len(pages) and {k: r[:5] for k, r in joined.items()} == {k: r[:5] for k, r in sent.items()}
    assert all(abs(joined[k][5] - sent[k][5]) < 1e-6 * (1 + abs(sent[k][5])) for k in joined)
    assert joined[0][3:5] == ("com/", "allow") and joined[1][3:5] == ("net/fr/", "block") and joined[2][3] is None
