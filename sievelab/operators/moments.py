"""Sums, cross products and exact percentiles per group, reduced in a tree so that no task sees all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievelab.operators.ranking import ordered_rank
from sievelab.session import cut_lineage

FAN_IN = 32


def group_moments(
    df: DataFrame, weigh: Callable[[pd.DataFrame], dict] | Callable[[pa.RecordBatch], dict], width: int, arrow: bool = False
) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """{(group, start): (n, sum, cross products)} over the rows that ``weigh`` picks.

    ``weigh`` takes a batch, a frame or (``arrow``) a record batch, and gives {(group, start): matrix of the picked rows}. Each task adds up its
    rows, at most ``FAN_IN`` of these sums are merged at a time however many tasks there were, and groups x starts matrices of width x width
    reach the driver.
    """
    size = 1 + width + width * width

    def partial(batches: Iterator) -> Iterator[list[tuple[int, int, list[float]]]]:
        held: dict = {}
        for batch in batches:
            for key, x in weigh(batch).items():
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]) if len(x) else np.zeros(size)
                held[key] = held.get(key, 0.0) + part
        if held:
            yield [(g, s, v.tolist()) for (g, s), v in held.items()]

    def of_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (pd.DataFrame(rows, columns=["grp", "start", "v"]) for rows in partial(batches))

    fields = pa.schema([("grp", pa.int32()), ("start", pa.int32()), ("v", pa.list_(pa.float64()))])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in partial(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    schema = "grp int, start int, v array<double>"

    def add(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[[0]][["grp", "start"]]
        total = np.zeros(size)
        for v in part["v"]:
            total += v
        return first.assign(v=[total.tolist()])

    partials = df.mapInArrow(of_batches, schema) if arrow else df.mapInPandas(of_frames, schema)
    sums = cut_lineage(partials.withColumn("lane", F.spark_partition_id()))
    lanes = 1 + (sums.agg(F.max("lane")).first()[0] or 0)
    while lanes > FAN_IN:
        lanes = math.ceil(lanes / FAN_IN)
        sums = (
            sums.withColumn("lane", F.pmod("lane", F.lit(lanes)))
            .groupBy("grp", "start", "lane")
            .applyInPandas(
                lambda p: add(p).assign(lane=p["lane"].iloc[0]), "grp int, start int, v array<double>, lane int"
            )
        )
    out = {}
    for r in sums.select("grp", "start", "v").groupBy("grp", "start").applyInPandas(add, schema).collect():
        v = np.array(r["v"])
        out[(r["grp"], r["start"])] = (v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width))
    return out


def feature_width(df: DataFrame, features: str = "features") -> int:
    return int(df.agg(F.max(F.size(features)).alias("d")).first()["d"])


def stack_rows(batch: pd.DataFrame, features: str = "features") -> np.ndarray:
    return np.stack(batch[features].to_numpy()).astype(float)


def exact_percentile(df: DataFrame, value: str, share: float, key: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, cut): the percentile with linear interpolation between the two closest rows, per group.

    The rows are ranked by a range-partitioned sort; two rows per group are kept.
    """
    by = list(by)
    ranked = ordered_rank(df.select(*by, key, value), [value, key], "__rank", by=by)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    place = F.lit(share) * (F.col("__n") - 1) + 1
    joined = ranked.join(F.broadcast(counts), by) if by else ranked.withColumn("__n", F.lit(df.count()))
    near = joined.withColumn("__p", place).filter(
        (F.col("__rank") == F.floor("__p")) | (F.col("__rank") == F.ceil("__p"))
    )
    low, high = F.min_by(value, "__rank"), F.max_by(value, "__rank")
    fraction = F.first("__p") - F.floor(F.first("__p"))
    return near.groupBy(*by).agg((low + (high - low) * fraction).alias("cut"))
