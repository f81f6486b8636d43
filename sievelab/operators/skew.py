"""Joins on keys of which one may hold a large part of all rows, and tables that come as too few splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
LANES = 1024


def lookup_join(
    fact: DataFrame, dim: DataFrame, key: str, spread: Column, count: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of a large fact table with a table holding one row per key, safe for hot keys.

    ``count`` names the column of ``dim`` with the rows per key, in the fact table or one like it. Keys
    of at least ``hot_rows`` rows, of which there are at most rows / hot_rows, are broadcast. The rest
    is joined by a shuffle in which rows that have found a hot key are dealt out by ``spread`` over
    lanes that hold no other rows, so no task gets them together. The fact table moves once.
    """
    values = [c for c in dim.columns if c not in (key, count)]
    payload = F.struct(*values) if values else F.lit(True)
    hot = dim.filter(F.col(count) >= hot_rows).select(key, payload.alias("__hot"))
    cold = dim.filter(F.col(count) < hot_rows).select(key, F.lit(0).alias("__lane"), payload.alias("__cold"))
    lane = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(LANES)).cast("int") + 1)
    found = (
        fact.join(F.broadcast(hot), key, "left")
        .withColumn("__lane", lane)
        .join(cold, [key, "__lane"], "left")
        .withColumn("__found", F.coalesce("__hot", "__cold"))
        .filter(F.col("__found").isNotNull())
    )
    return found.select(*fact.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out when a table is read in fewer splits than there are cores, as a single file is.

    Work per row, such as taking texts apart, would run in that few tasks otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
