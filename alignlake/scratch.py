"""Tables written on the way to a result, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPES: list[Scope] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scope:
    """Owner of the scratch tables that are written while it is entered: what isn't kept goes when it is left.

    ``with scope(spark) as mine: out = mine.keep(materialise(...))``; a kept table belongs to the scope around it, if
    there is one.  Results that are still to be computed from tables written inside must not outlive the scope.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.discard(_PATHS[df])
        if len(_SCOPES) > 1:
            _SCOPES[-2].paths.add(_PATHS[df])
        return df

    def __enter__(self) -> Scope:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCOPES.remove(self)
        remove(self.spark, *self.paths)


def scope(spark: SparkSession) -> Scope:
    return Scope(spark)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; what is left of it goes when the application ends.

    Only where the setting is missing on a local master (tests) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/alignlake-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _SCOPES:
        _SCOPES[-1].paths.add(path)
    return path


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as each has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write a scratch table."""
    with freed_shuffles(df.sparkSession):
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)


def materialise(df: DataFrame) -> DataFrame:
    """Write to a scratch table and read it back: cuts the lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete the scratch tables that ``materialise`` gave, once nothing reads them any more."""
    for df in tables:
        if df in _PATHS:
            remove(df.sparkSession, _PATHS.pop(df))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with as many underscores before it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number for each row, written once so that every later job reads the same numbers."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()))
