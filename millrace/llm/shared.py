"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What Python workers keep between tasks of one kind, which is of no use to others.
CACHES: list[dict] = []


def let_go() -> None:
    """Empties the caches of a worker that goes on to other work, so that its memory does not add up."""
    for cache in CACHES:
        cache.clear()


_STAGED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and driver and tasks are one process (a local master, as in tests), a local one; else an error,
    as executors would write to folders that nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/millrace/{uuid.uuid4().hex}-{name}"
    _STAGED.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    _release(df.sparkSession)
    return out


def _release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_staged(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`staged` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._staged_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # the session has already ended
            return


def ascii_lower(c: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).cast("binary")


def running_total(df: DataFrame, order: list[str], value: str, out: str, parts: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in ``order`` (nulls first).

    Rows that are equal in ``order`` come one after the other in any order, so their sums are told apart but may change
    places. Rows are dealt by range, so that no task holds all rows; the dealt table is written with its range number, and only
    one sum for each range is brought together.
    """
    dealt = (
        df.repartitionByRange(parts, *order)
        .withColumn("__range", F.spark_partition_id())
        .sortWithinPartitions(*order)
    )
    dealt = staged(dealt, "ranges")
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(sums, "__range")
        .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("__base")
    )
