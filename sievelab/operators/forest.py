"""Isolation forest (Liu, Ting and Zhou 2008): trees from small row samples, scored in batches of trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sievelab.operators.moments import exact_percentile, feature_width
from sievelab.operators.ranking import hash_rank
from sievelab.session import cut_lineage

TREE_BATCH = 500
_TREE = "tree int, feature array<int>, cut array<double>, child array<int>, path array<double>"


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, columns: np.ndarray, rng: np.random.Generator, depth: int) -> dict[str, list]:
    """One tree as flat node lists; ``child`` is the first of two neighbouring children or -1 at a leaf."""
    nodes: dict[str, list] = {"feature": [0], "cut": [0.0], "child": [-1], "path": [0.0]}
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, rows, level = open_nodes.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if level >= depth or len(rows) <= 1 or not len(usable):
            nodes["path"][node] = level + average_path(len(rows))
            continue
        j = int(rng.choice(usable))
        cut = float(rng.uniform(low[j], high[j]))
        left = x[rows, j] <= cut
        first = len(nodes["cut"])
        nodes["feature"][node], nodes["cut"][node], nodes["child"][node] = int(columns[j]), cut, first
        for side, keep in ((0, left), (1, ~left)):
            for name, empty in (("feature", 0), ("cut", 0.0), ("child", -1), ("path", 0.0)):
                nodes[name].append(empty)
            open_nodes.append((first + side, rows[keep], level + 1))
    return nodes


def build_trees(df: DataFrame, trees: int, sample: int = 256, features: int = 3, seed: int = 1) -> DataFrame:
    """One row per tree. Only ids are ranked; sample positions are drawn on the executors and joined to
    them, so vectors move for trees x ``sample`` rows whatever the table size, and a task grows one tree."""
    spark = df.sparkSession
    total, width = df.count(), feature_width(df)
    take, used = min(sample, total), min(features, width)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                rows = rng.choice(total, take, replace=False) + 1
                columns = np.sort(rng.choice(width, used, replace=False)).tolist()
                yield pd.DataFrame({"tree": int(tree), "place": rows, "columns": [columns] * take})

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        tree, columns = int(part["tree"].iloc[0]), np.asarray(part["columns"].iloc[0])
        rng = np.random.default_rng([seed, tree, 1])
        nodes = _grow(np.stack(part["x"].to_numpy()), columns, rng, math.ceil(math.log2(max(take, 2))))
        return pd.DataFrame({"tree": [tree], **{name: [v] for name, v in nodes.items()}})

    draws = spark.range(trees).mapInPandas(draw, "tree int, place bigint, columns array<int>")
    places = hash_rank(df.select("row_id"), ["row_id"], seed, rank_col="place")
    picked = draws.join(places, "place").join(df.select("row_id", "features"), "row_id").select(
        "tree", "place", "columns", F.transform("columns", lambda c: F.get("features", c)).alias("x")
    )
    return picked.groupBy("tree").applyInPandas(grow, _TREE)


def _add_paths(df: DataFrame, forest: list) -> DataFrame:
    """Adds to ``paths`` the path lengths of each row through one batch of trees."""
    held = df.sparkSession.sparkContext.broadcast(
        [tuple(np.asarray(r[c]) for c in ("feature", "cut", "child", "path")) for r in forest]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["features"].to_numpy())
            total = batch["paths"].to_numpy(dtype=float).copy()
            index = np.arange(len(x))
            for feature, cut, child, path in held.value:
                node = np.zeros(len(x), dtype=int)
                inner = child[node] >= 0
                while inner.any():
                    right = x[index, feature[node]] > cut[node]
                    node = np.where(inner, child[node] + right, node)
                    inner = child[node] >= 0
                total += path[node]
            yield batch.assign(paths=total)

    return df.mapInPandas(score, "row_id bigint, features array<double>, paths double")


def isolation_forest(
    df: DataFrame, trees: int = 200, sample: int = 256, features: int = 3, contamination: float = 0.1, seed: int = 1,
    tree_batch: int = TREE_BATCH,
) -> DataFrame:
    """(row_id, score, markasnoise): score is 0 at the cut and lower for stranger rows; the lowest
    ``contamination`` share is flagged.

    Trees are written once and sent to the executors ``tree_batch`` at a time (some 10 MB), so their
    number is not bound by what one broadcast can hold.
    """
    forest = cut_lineage(build_trees(df, trees, sample, features, seed))
    rows = df.select(F.col("row_id").cast("bigint"), "features").withColumn("paths", F.lit(0.0))
    for start in range(0, trees, tree_batch):
        batch = forest.filter((F.col("tree") >= start) & (F.col("tree") < start + tree_batch)).orderBy("tree").collect()
        rows = _add_paths(rows, batch)
    unit = average_path(min(sample, df.count()))
    raw = -F.pow(F.lit(2.0), -F.col("paths") / F.lit(trees * (unit or 1.0)))
    scored = cut_lineage(rows.select("row_id", raw.alias("raw")))
    cut = exact_percentile(scored, "raw", contamination).first()["cut"]
    return scored.select(
        "row_id", (F.col("raw") - cut).alias("score"), (F.col("raw") < cut).cast("int").alias("markasnoise")
    ).orderBy("score", "row_id")
