"""Session settings, and the folder for tables that all executors read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ANSI stays on, as no expression here relies on errors."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. On one machine a temporary folder will do where that is unset; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder, or to path, and read again: work that follows does not repeat what made it, and lost executors cost nothing."""
    path = path or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def narrow_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside, whose rows of a few numbers go to Python: the bytes of a batch are not added up anew at each row, as its rows are bounded anyway."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
