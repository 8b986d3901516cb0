"""JSON arrays that are read in pieces: items are cut rightly wherever splits fall, and what is no array is refused."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_sources import case, write

from gradewell.sources import readers
from gradewell.sources.arrays import array_items

ITEMS = [{"a": 'x"}],[{' * (k % 4) + "\\" * (k % 3) + "größe\n", "b": [k, {"c": [[], {}, "}"]}]} for k in range(300)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", ["97", "1000", "128m"])
def test_an_array_is_cut_anywhere(spark, tmp_path, split, indent):
    (tmp_path / "a.json").write_text("﻿ " + json.dumps([*ITEMS, 7, "}", [], None], ensure_ascii=False, indent=indent) + "\n ", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = array_items(spark, str(tmp_path / "a.json")).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["pos"] for r in got] == list(range(304)) and [json.loads(r["json"]) for r in got] == [*ITEMS, 7, "}", [], None]


@pytest.mark.parametrize("text", ["", " ", "{}", '{"a":1}', "[", "]", "[{}", "[{}]}", "[{}]]", "[{}][{}]", "[{},]", "[,{}]", "[{},,{}]", "[{}] x", "x [{}]", "[{}}", '[{"a":"}]', "7"])
def test_what_is_no_array_is_refused(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="no JSON array"):
        array_items(spark, str(tmp_path / "a.json"))


def test_an_empty_array(spark, tmp_path):
    (tmp_path / "a.json").write_text("[ \n]")
    assert array_items(spark, str(tmp_path / "a.json")).isEmpty()


def test_cases_are_no_single_row(spark, tmp_path):
    """No task sees a whole file: before, its text was one row."""
    path = write(tmp_path / "cases.json", [case(str(k)) for k in range(200)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = readers.read_cases(spark, path)
        assert [r["case_id"] for r in read.orderBy("pos").collect()] == [str(k) for k in range(200)]
        assert read.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
