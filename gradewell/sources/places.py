"""Where files go that driver and executors must both see."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one in local mode, as in tests, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="gradewell-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextlib.contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table or file that is written within goes as soon as that is written, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed: what comes after doesn't run it again, also if an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, where checkpoint() computes it twice. It goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/gradewell-table-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    with unshuffled(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, folder: str) -> None:
    """The folder goes when the driver ends."""
    _written.append((spark, folder))


@atexit.register
def _at_exit() -> None:
    for spark, place in _written:
        with contextlib.suppress(Exception):  # the session may have ended
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
