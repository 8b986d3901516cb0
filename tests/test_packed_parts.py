"""Large files of bundles are packed parts: they take little disk, unpacked they are the file, and nothing that was shuffled for them stays."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradewell.plans import checks
from gradewell.plans.queries import QUERIES
from gradewell.sources import readers, sinks
from gradewell.sources.arrays import array_items

DATA = "/root/testdata/sf0.001"


def unpacked(path) -> bytes:
    return b"".join(gzip.decompress(p.read_bytes()) for p in sorted(path.glob("part-*"))) if path.is_dir() else path.read_bytes()


def shuffled(spark) -> dict[str, int]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize(("name", "large"), [("bundle_round_trip", {"scores.jsonl", "outputs.jsonl", "events.jsonl", "inputs_manifest.json", "timing.csv", "failures.jsonl"}), ("pilot_bundle", {"scores.jsonl", "case_receipts.jsonl", "timing.csv", "failures.jsonl", "BASELINE_REPORT.md"})])
def test_bundles_are_packed(spark, tmp_path, monkeypatch, name, large):
    monkeypatch.setattr(sinks, "PART_BYTES", 20_000)
    monkeypatch.setattr(checks, "_folder", lambda _: str(tmp_path / "f"))
    QUERIES[name](spark, DATA)
    top = next(p for p in Path(tmp_path / "f").iterdir() if p.is_dir())
    assert {p.name for p in top.iterdir() if p.is_dir()} == large
    for f in large:
        assert {p.suffix for p in (top / f).glob("part-*")} == {".gz"} and max(len(gzip.decompress(p.read_bytes())) for p in (top / f).glob("part-*")) < 25_000
    text = sum(len(unpacked(top / f)) for f in large)
    assert sum(p.stat().st_size for f in large for p in (top / f).glob("part-*")) < text / 4
    assert len(unpacked(top / "scores.jsonl").splitlines()) == 4000 and unpacked(top / "timing.csv").startswith(b"case_id,")


def test_packed_parts_are_the_file(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).repartition(7).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k"), F.concat(F.lit("a,b} ü "), F.col("id").cast("string")).alias("t"))
    writers = {
        "l.jsonl": lambda p: sinks.write_jsonl(rows, p, ["k"], packed=True), "a.json": lambda p: sinks.write_array(rows, p, ["k"], packed=True), "c.csv": lambda p: sinks.write_csv(rows, p, ["k"], ["k", "t"], packed=True),
    }
    for folder, size in (("one", 64 << 20), ("two", 10_000), ("three", 10_000)):
        monkeypatch.setattr(sinks, "PART_BYTES", size)
        for name, put in writers.items():
            put(str(tmp_path / folder / name))
    for name in writers:
        one, two, three = (tmp_path / f / name for f in ("one", "two", "three"))
        assert one.is_file() and one.read_bytes() == unpacked(two) and len(list(two.glob("part-*"))) > 1
        assert {p.name: p.read_bytes() for p in two.glob("part-*.gz")} == {p.name: p.read_bytes() for p in three.glob("part-*")}
    assert not list(tmp_path.glob("*/*.part-*"))
    for folder in ("one", "two"):
        assert dict(map(tuple, readers.line_counts(spark, str(tmp_path / folder)).collect())) == {"l.jsonl": 5000, "a.json": 1, "c.csv": 5001}
        assert [json.loads(r["json"])["t"] for r in array_items(spark, str(tmp_path / folder / "a.json")).orderBy("pos").collect()] == [f"a,b}} ü {k}" for k in range(5000)]
        assert readers.read_jsonl(spark, str(tmp_path / folder / "l.jsonl"), "k string").distinct().count() == 5000
    found = {r["path"]: tuple(r)[1:] for r in readers.file_digests(spark, str(tmp_path / "two")).collect()}
    for name in writers:
        parts = sorted((tmp_path / "two" / name).glob("part-*"))
        assert found[name] == (hashlib.sha256("".join(f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.name}\n" for p in parts).encode()).hexdigest(), sum(p.stat().st_size for p in parts))


def test_nothing_shuffled_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_BYTES", 50_000)
    rows = spark.range(5000).repartition(7).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))  # 320 kB
    before = shuffled(spark)
    sinks.write_jsonl(rows, str(tmp_path / "l.jsonl"), ["k"], packed=True)
    assert sum(size for name, size in shuffled(spark).items() if name not in before) < 20_000  # counts of files and lines


@pytest.mark.parametrize("texts", [['[{"a":1}', ',{"a":2}]'], ['[{"a":1},', '{"a":2}]\n'], ['[{"a":1},{"a"', ":2}]"], ["[1,", "2]"], ['﻿[{"a":1}', ",2]"], ["[]"]])
@pytest.mark.parametrize(("pack", "end"), [(gzip.compress, ".gz"), (bz2.compress, ".bz2"), (bytes, "")])
def test_packed_arrays(spark, tmp_path, texts, pack, end):
    for k, text in enumerate(texts):
        (tmp_path / f"part-{k:05d}{end}").write_bytes(pack(text.encode()))
    found = [json.loads(r["json"]) for r in array_items(spark, str(tmp_path)).orderBy("pos").collect()]
    assert found == json.loads("".join(texts).removeprefix("﻿"))
