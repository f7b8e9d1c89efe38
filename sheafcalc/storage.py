"""Cutting lineage in loops by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only where that is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheafcalc-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheafcalc-{uuid.uuid4().hex}"


STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def sizes_measured(spark: SparkSession) -> Iterator[None]:
    """Joins planned within broadcast a side only where its shuffled bytes turn out to be below the session's threshold: sizes of
    files say little, as a few MB of them can be millions of cells, which would all pass through the driver."""
    old = {k: spark.conf.get(k, None) for k in (STATIC, MEASURED)}
    try:
        spark.conf.set(MEASURED, old[MEASURED] or spark.conf.get(STATIC))
        spark.conf.set(STATIC, "-1")
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored(df: DataFrame, by: str | None = None, even: bool = False) -> DataFrame:
    """df written as Parquet (a folder for each value of `by`) and read again: later steps do not recompute it, also when
    an executor is lost. Values of `by` with many rows are dealt over tasks of one size, not one task for each; even: they are so already."""
    path = folder(df.sparkSession)
    out = df.write if by is None else (df if even else df.hint("rebalance", by)).write.partitionBy(by)
    with sizes_measured(df.sparkSession):
        out.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """df stored, unless it is a stored table."""
    return df if hasattr(df, "_folder") else stored(df)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_folder", None):
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
