"""Queries with SQL give the rows of their SQL; the others give a row for each row of their table."""

from __future__ import annotations

import os

import duckdb
import pytest

from gradewell.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    found = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize(("name", "table"), [("op3_token_counts", "documents"), ("op4_sentencepiece", "documents"), ("op5_url_filter", "pages"), ("op6_quality", "documents"), ("op9_language", "documents")])
def test_rows(spark, con, name, table):
    df = QUERIES[name](spark, DATA)
    assert df.count() == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name == "op4_sentencepiece":
        assert df.where("NOT lossless").isEmpty()
