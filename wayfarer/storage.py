"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir. One of this machine alone only where that is unset and all runs in this one process."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("wayfarer.local.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wayfarer-")
        spark.conf.set("wayfarer.local.dir", found)
    return found


_open: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The scratch paths that are made meanwhile, but for those that an inner collected() gets."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.pop()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/wayfarer-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives a lost executor, computes once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in it are deleted as each ends: nothing reads them after, since the table is in the shared folder."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """stored(build(), name); the tables that build() stored on the way are removed, since nothing reads them any more."""
    with collected() as made:
        df = build()
    out = stored(df, name)
    remove(spark, made)
    return out
