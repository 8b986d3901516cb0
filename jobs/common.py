"""What the jobs share: logging, reading a config, counting what is written while it is written."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config(name: str) -> dict:
    """The config file beside a job."""
    return json.loads((Path(__file__).parent / f"{name}.json").read_text())


def read(spark: SparkSession, path: str, columns: str, form: str = "parquet") -> DataFrame:
    """columns: DDL of what the job reads; no more is, and files are not asked for their schema."""
    log.info("read %s (%s): %s", path, form, columns)
    return spark.read.format(form).schema(columns).load(path)


def write(df: DataFrame, path: str, by: tuple[str, ...], form: str = "parquet", dynamic: bool = False) -> int:
    """Overwrites a folder, partitioned; dynamic: only the partitions that df has. The number of rows comes from the job that writes them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*by).format(form).save(path)
    rows = seen.get.get("rows", 0)
    log.info("wrote %s (%s by %s): %d rows", path, form, ", ".join(by), rows)
    return rows


def main(name: str, paths: tuple[str, ...], run: Callable) -> None:
    """The command line: paths, a config file, a session that it alone creates and stops."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", default=str(Path(__file__).parent / f"{name}.json"))
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = json.loads(Path(args.pop("config")).read_text())
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, settings, **args)
    finally:
        spark.stop()
