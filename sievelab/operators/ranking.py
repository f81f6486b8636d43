"""Exact ranks without a one-task window.

``row_number`` over a class sends the whole class to one task. Both functions here first cut the
order into many buckets, count the buckets, and rank inside each bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sievelab.functions.hashing import hash_key
from sievelab.session import cut_lineage

BUCKET_DIGITS = 4


def hash_rank(
    df: DataFrame,
    ids: Sequence[str],
    seed: int | str,
    by: Sequence[str] = (),
    rank_col: str = "rank",
    keep_first: int | None = None,
) -> DataFrame:
    """1-based rank in the seeded random order, per group of ``by``.

    The leading hex digits of the MD5 key are the bucket: 16^4 buckets of near equal size however
    skewed the groups are. The table of bucket offsets has at most 65,536 rows per group, and ``by``
    must name a column of few values (a class label), so it is broadcast. Ranks above ``keep_first``
    are dropped by whole buckets before the shuffle.
    """
    by = list(by)
    keyed = df.withColumn("__key", hash_key(seed, *ids)).withColumn(
        "__bucket", F.substring("__key", 1, BUCKET_DIGITS)
    )
    group = [*by, "__bucket"]
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    if keep_first is not None:
        offsets = offsets.filter(F.col("__offset") < keep_first)
    within = Window.partitionBy(*group).orderBy("__key", *ids)
    ranked = keyed.join(F.broadcast(offsets), group).withColumn(
        rank_col, (F.col("__offset") + F.row_number().over(within)).cast("bigint")
    )
    if keep_first is not None:
        ranked = ranked.filter(F.col(rank_col) <= keep_first)
    return ranked.select(*df.columns, rank_col)


def ordered_rank(
    df: DataFrame, order: Sequence[str], rank_col: str = "rank", by: Sequence[str] = ()
) -> DataFrame:
    """1-based rank in the order of the given columns, which must identify a row.

    Rows are range-partitioned and sorted, the positions written once, and one offset per partition
    added. The written copy fixes the partition bounds, so both uses of it agree. With ``by`` (columns
    of few values) the rank starts anew in each group.
    """
    by = list(by)
    placed = cut_lineage(
        df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn(
            "__pos", F.monotonically_increasing_id()
        )
    ).withColumn("__part", F.shiftright("__pos", 33))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__start"))
        .select(*by, "__part", "__start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return (
        placed.join(F.broadcast(offsets), [*by, "__part"])
        .withColumn(rank_col, F.col("__pos") - F.col("__start") + F.col("__offset") + 1)
        .select(*df.columns, rank_col)
    )
