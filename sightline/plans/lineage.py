"""Cutting lineages through the folder that the cluster shares, and single evaluation inside expressions."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset and the driver is the only
    executor (local tests), a temporary folder is made once for the session; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df, written once to the shared folder and read again: the lineage ends there, and a lost
    executor costs no more than the tasks that read the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    note(path)
    return out


def bucketed(rows: DataFrame, key: str, compression: str = "zstd", n: int | None = None) -> DataFrame:
    """rows, written once to the shared folder in n buckets of key (by default as many as a shuffle has partitions): every later
    join, window or grouping by it reads them without a shuffle."""
    spark = rows.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"rows_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows.repartition(n, key).write.bucketBy(n, key).option("compression", compression).option("path", path).saveAsTable(name)
    note(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # leaves the files, which out reads, but no entry in the catalog
    return out


#: The paths that are written while a scope is open, for each open scope.
_scopes: list[list[str]] = []


def note(path: str) -> None:
    """Tells open scopes of files that were written for use in between."""
    for made in _scopes:
        made.append(path)


@contextlib.contextmanager
def scope(made: list[str]) -> Iterator[None]:
    """Files that are written meanwhile, for use in between, are added to made."""
    _scopes.append(made)
    try:
        yield
    finally:
        # by identity: two lists that are equal are two scopes
        del _scopes[next(i for i, x in enumerate(_scopes) if x is made)]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, in whatever store they are."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that cut() gave, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, [df._cut_path])


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of finished steps now: Spark deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
