"""Working tables: written once to the shared folder, so that what several parts of a plan read is
computed once, and an executor lost later costs no recomputation of it."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Paths of the tables made in this process.
made: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of this machine, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="kinmatch-"))
    return _own[0]


def cut(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, from a table."""
    path = f"{folder(df.sparkSession)}/kinmatch/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_last(df: DataFrame, tag: str, start: int) -> DataFrame:
    """Like ``cut``; the tables made from number ``start`` on before it, which only ``df`` reads, go."""
    out = cut(df, tag)
    last = made.pop()
    clear(df.sparkSession, start)
    made.append(last)
    return out


#: Whether what a join reads must lie by all of its keys; else rows dealt by one of them stay.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def by_block(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile join rows that are dealt by one of the keys where they lie."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def release(spark: SparkSession) -> None:
    """Have the driver forget shuffles that no plan refers to any more, so that their files go."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession, start: int = 0) -> None:
    """Delete the tables made from number ``start`` on; results that still read them are void."""
    for at in made[start:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del made[start:]
