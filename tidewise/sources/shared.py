"""A written table in the folder that driver and executors share, to cut lineage and to read a costly result more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session (tests) may do without; a cluster's executors would not see ours."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidewise-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


#: Where the tables of materialise are.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPES: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path for it)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside go at the end, but for those given to the function that it yields.

    Whatever reads the others has to be written (or collected) inside as well.
    """
    mine: set[str] = set()
    outer = _SCOPES.get()
    token = _SCOPES.set((*outer, mine))

    def keep(table: DataFrame) -> DataFrame:
        mine.discard(path := _WRITTEN[table])
        if outer:
            outer[-1].add(path)
        return table

    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for path in mine:
            remove(spark, path)


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder, with options of the writer, and read it back.

    The table survives lost executors, has a known size (so that later joins are planned by it) and is pruned by column.
    It stays until the shared folder is cleaned, as checkpoint files do, or until the `scratch` around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewise/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if scopes := _SCOPES.get():
        scopes[-1].add(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def versions(spark: SparkSession, *paths: str) -> tuple[tuple[str, int, int], ...]:
    """(path, size, time of change) of every file below the paths: what a result that is kept depends on."""
    found = []
    for path in paths:
        fs, where = file_system(spark, path)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)]
    return tuple(sorted(found))
