"""The queries that write files, with parts so small that even the smallest tables make many: the rows are those of the SQL."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from gradewell.plans import checks
from gradewell.plans.queries import ORACLES, QUERIES
from gradewell.sources import sinks

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.mark.parametrize(("name", "cut"), [("bundle_round_trip", {"scores.jsonl", "outputs.jsonl", "events.jsonl", "inputs_manifest.json", "timing.csv", "failures.jsonl"}), ("pilot_bundle", {"scores.jsonl", "case_receipts.jsonl", "timing.csv", "failures.jsonl", "BASELINE_REPORT.md"})])
def test_bundles_in_parts(spark, tmp_path, monkeypatch, name, cut):
    monkeypatch.setattr(sinks, "PART_BYTES", 20_000)
    monkeypatch.setattr(checks, "_folder", lambda _: str(tmp_path / "f"))
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    found = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    files = [p for p in Path(tmp_path / "f").glob("*/*") if not p.name.startswith(".")]
    assert {p.name for p in files if p.is_dir()} == cut
    assert max(p.stat().st_size for p in Path(tmp_path / "f").rglob("*") if p.is_file()) < 40_000
