"""Helpers shared by the operators: tables, text expressions, shared scratch tables, model bounds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelab.operators.skew import spread_rows
from sievelab.session import scratch_path

#: White space as the contracts name it: space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the operator's own names, so that extra or clashing ones cannot interfere."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def spread(df: DataFrame, key: str) -> DataFrame:
    return spread_rows(df, key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of anything but white space, in order."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def written(df: DataFrame, name: str, with_path: bool = False):
    """The rows written once to the shared folder and read from there: work behind it is never repeated
    and outlives any executor. With ``with_path`` also the folder, for ``drop_path`` when it is no longer read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, path) if with_path else back


def crc_fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table of this module's own making."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark removes shuffles and checkpoints once nothing refers to them, which a roomy heap puts off for long."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Returns memory that is free inside this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on batches in a worker that goes on to other stages: at the end of a task its memory is given back."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run
