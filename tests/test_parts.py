"""Files of several parts: written and read side by side, in the order and with the bytes of one file."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gradewell.sources import readers, sinks
from gradewell.sources.arrays import array_items


def whole(path) -> bytes:
    return b"".join(p.read_bytes() for p in sorted(path.iterdir()) if not p.name.startswith(".")) if path.is_dir() else path.read_bytes()


def test_a_large_file_is_parts(spark, tmp_path, monkeypatch):
    rows = spark.range(5000).repartition(7).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k"), F.concat(F.lit("a,b "), F.col("id").cast("string")).alias("t"))
    writers = {
        "l.jsonl": lambda p: sinks.write_jsonl(rows, p, ["k"]), "a.json": lambda p: sinks.write_array(rows, p, ["k"]), "c.csv": lambda p: sinks.write_csv(rows, p, ["k"], ["k", "t"]),
        "d.txt": lambda p: sinks.write_lines(rows.withColumn("line", F.lit("same")), p, ["k"]),
    }
    for folder, size in (("one", 64 << 20), ("two", 10_000), ("three", 10_000)):
        monkeypatch.setattr(sinks, "PART_BYTES", size)
        for name, put in writers.items():
            put(str(tmp_path / folder / name))
    for name in writers:
        one, two, three = (tmp_path / f / name for f in ("one", "two", "three"))
        assert one.is_file() and len(list(two.glob("part-*"))) > 1 and max(p.stat().st_size for p in two.glob("part-*")) < 11_000
        assert whole(one) == whole(two) and {p.name: p.read_bytes() for p in two.glob("part-*")} == {p.name: p.read_bytes() for p in three.glob("part-*")}
    assert not list(tmp_path.glob("*/*.part-*"))
    assert whole(tmp_path / "one/l.jsonl").decode().splitlines() == [f'{{"k":"{k:05d}","t":"a,b {k}"}}' for k in range(5000)]
    counts = {"l.jsonl": 5000, "a.json": 1, "c.csv": 5001, "d.txt": 5000}
    for folder in ("one", "two"):
        assert dict(map(tuple, readers.line_counts(spark, str(tmp_path / folder)).collect())) == counts
    assert [json.loads(r["json"])["t"] for r in array_items(spark, str(tmp_path / "two/a.json")).orderBy("pos").collect()] == [f"a,b {k}" for k in range(5000)]
    assert readers.read_jsonl(spark, str(tmp_path / "two/l.jsonl"), "k string").count() == 5000
    found = {r["path"]: tuple(r)[1:] for r in readers.file_digests(spark, str(tmp_path / "two")).collect()}
    for name in writers:
        parts = sorted((tmp_path / "two" / name).glob("part-*"))
        assert found[name] == (hashlib.sha256("".join(f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.name}\n" for p in parts).encode()).hexdigest(), sum(p.stat().st_size for p in parts))
    with pytest.raises(FileExistsError):
        writers["l.jsonl"](str(tmp_path / "two/l.jsonl"))
    with pytest.raises(FileExistsError):
        writers["a.json"](str(tmp_path / "two/a.json"))


def test_an_empty_file(spark, tmp_path):
    none = spark.createDataFrame([], "k string")
    sinks.write_jsonl(none, str(tmp_path / "l.jsonl"), ["k"])
    sinks.write_array(none, str(tmp_path / "a.json"), ["k"])
    assert whole(tmp_path / "l.jsonl") == b"" and whole(tmp_path / "a.json") == b"[]\n"
