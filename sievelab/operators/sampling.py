"""Repeatable class-stratified regions, subsets and samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from sievelab.functions.hashing import hash_key
from sievelab.operators.ranking import hash_rank

REGIONS = ("train", "test", "validation", "noise")


class CapacityError(ValueError):
    """A class or region holds fewer rows than a split asks for."""


def class_quota(size: int, shares: Sequence[float]) -> list[int]:
    """Rows per class for a set of ``size``: half-even rounded shares, the last class takes the rest."""
    counts = [int(round(size * p)) for p in shares[:-1]]
    return [*counts, size - sum(counts)]


def largest_remainder_quota(size: int, class_counts: Sequence[int]) -> list[int]:
    """Rows per class in proportion to ``class_counts``, adding up to ``size`` exactly."""
    total = sum(class_counts)
    floors = [size * n // total for n in class_counts]
    order = sorted(range(len(class_counts)), key=lambda i: (-(size * class_counts[i] % total), i))
    for i in order[: size - sum(floors)]:
        floors[i] += 1
    return floors


def _laid_out(counts: dict[str, list[int]]) -> list[tuple[str, int, int, int]]:
    """Regions one after the other within each class."""
    rows, at = [], None
    for region, need in counts.items():
        at = at or [0] * len(need)
        rows += [(region, label, at[label], at[label] + n) for label, n in enumerate(need)]
        at = [start + n for start, n in zip(at, need)]
    return rows


@dataclass(frozen=True)
class SplitPlan:
    """Class counts and region sizes; holds numbers only, never rows."""

    class_counts: list[int]
    sizes: dict[str, int]
    shares: list[float] = field(init=False)

    def __post_init__(self):
        total = sum(self.class_counts)
        object.__setattr__(self, "shares", [n / total for n in self.class_counts])

    @property
    def total(self) -> int:
        return sum(self.class_counts)

    def quota(self, region: str) -> list[int]:
        """What the shares ask of each class for the region."""
        return class_quota(self.sizes.get(region, 0), self.shares)

    def counts(self) -> dict[str, list[int]]:
        """Rows of each class in each region: the quota, but where rounding asks a class for more than it
        has left, the missing rows come from the classes with most to spare."""
        self.check()
        left, out = list(self.class_counts), {}
        for region in REGIONS:
            need = self.quota(region)
            take = [min(n, have) for n, have in zip(need, left)]
            missing = sum(need) - sum(take)
            spare = [have - n for n, have in zip(take, left)]
            for label in sorted(range(len(spare)), key=lambda i: (-spare[i], i)):
                extra = min(spare[label], missing)
                take[label] += extra
                missing -= extra
            left = [have - n for have, n in zip(left, take)]
            out[region] = take
        return out

    def bounds(self) -> list[tuple[str, int, int, int]]:
        """(region, class, first, last) with first exclusive; regions follow each other without overlap."""
        return _laid_out(self.counts())

    def check(self) -> None:
        if sum(self.sizes.values()) > self.total:
            raise CapacityError(f"regions need {sum(self.sizes.values())} rows, only {self.total} available")

    def subset_quota(self, region: str, size: int | None = None, shares: Sequence[float] | None = None) -> list[int]:
        """Rows per class of a subset of a region; refuses what the region cannot give."""
        size = self.sizes[region] if size is None else size
        if size > self.sizes[region]:
            raise CapacityError(f"{size} rows asked of region {region} with {self.sizes[region]}")
        held = self.counts()[region]
        if shares is None and size == self.sizes[region]:
            return held
        need = class_quota(size, self.shares if shares is None else shares)
        for label, (n, have) in enumerate(zip(need, held)):
            if n > have:
                raise CapacityError(f"class {label} of region {region}: {n} rows asked, {have} available")
        return need


def count_classes(df: DataFrame, label_count: int | None = None, label: str = "sentiment") -> list[int]:
    """Rows per class 0..k-1; one aggregate, k numbers reach the driver."""
    rows = df.groupBy(label).count().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{label} is not a class column")
    counts = {int(r[0]): int(r[1]) for r in rows}
    k = label_count if label_count is not None else max(counts) + 1
    return [counts.get(i, 0) for i in range(k)]


def seeded_shuffle(df: DataFrame, ids: Sequence[str], seed: int, by: Sequence[str] = ("sentiment",)) -> DataFrame:
    """Adds ``class_rank``, the place of each row in the seeded order of its class."""
    return hash_rank(df, ids, seed, by=by, rank_col="class_rank")


def _bounds_frame(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def stratified_regions(ranked: DataFrame, plan: SplitPlan) -> DataFrame:
    """Adds ``region`` and ``region_rank`` (place in class and region). Rows outside all regions get null."""
    bounds = _bounds_frame(ranked, plan.bounds(), "region string, sentiment int, __start bigint, __end bigint")
    inside = (
        (ranked["sentiment"] == bounds["sentiment"])
        & (ranked["class_rank"] > bounds["__start"])
        & (ranked["class_rank"] <= bounds["__end"])
    )
    return ranked.join(bounds, inside, "left").select(
        *[ranked[c] for c in ranked.columns],
        "region",
        (F.col("class_rank") - F.col("__start")).alias("region_rank"),
    )


def subset_with_distribution(
    regions: DataFrame, plan: SplitPlan, region: str, size: int | None = None, shares: Sequence[float] | None = None
) -> DataFrame:
    """First rows of each class of a region, as many as the shares ask for."""
    need = plan.subset_quota(region, size, shares)
    limits = _bounds_frame(regions, list(enumerate(need)), "sentiment int, __need bigint")
    return (
        regions.filter(F.col("region") == region)
        .join(limits, "sentiment")
        .filter(F.col("region_rank") <= F.col("__need"))
        .select(*regions.columns)
    )


def capacity_check(df: DataFrame, plan: SplitPlan) -> DataFrame:
    """(region, sentiment, need, have, ok): what each region asks of each class and what is left for it."""
    have = df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("__total"))
    asked = _laid_out({region: plan.quota(region) for region in REGIONS})
    bounds = _bounds_frame(df, asked, "region string, sentiment int, __start bigint, __end bigint")
    left = F.greatest(F.lit(0), F.coalesce(F.col("__total"), F.lit(0)) - F.col("__start")).cast("bigint")
    need = F.col("__end") - F.col("__start")
    return bounds.join(have, "sentiment", "left").select(
        "region", "sentiment", need.alias("need"), left.alias("have"), (need <= left).cast("int").alias("ok")
    )


def size_ladder(regions: DataFrame, plan: SplitPlan, sizes: Sequence[int], region: str = "train") -> DataFrame:
    """Membership of nested training sets: one row per (size, row), from one pass over the region."""
    limits = [
        (size, label, need)
        for size in sizes
        for label, need in enumerate(plan.subset_quota(region, size))
    ]
    limits = _bounds_frame(regions, limits, "size int, sentiment int, __need bigint")
    return (
        regions.filter(F.col("region") == region)
        .join(limits, "sentiment")
        .filter(F.col("region_rank") <= F.col("__need"))
        .select("size", *regions.columns)
    )


def stratified_two_way_split(df: DataFrame, ids: Sequence[str], seed: int, size: int | None = None) -> DataFrame:
    """Adds ``part``: 1 for a stratified subset of exactly ``size`` rows, 2 for the rest.

    Quotas are for one row more than asked; the last of those rows in the seeded order goes to part 2.
    ``size`` of None or 1 puts all rows into part 1.
    """
    if size is None or size == 1:
        return df.withColumn("part", F.lit(1))
    counts = count_classes(df)
    total = sum(counts)
    if size > total:
        raise CapacityError(f"{size} rows asked of a set of {total}")
    if size == total:
        return df.withColumn("part", F.lit(1))
    quota = largest_remainder_quota(size + 1, counts)
    limits = _bounds_frame(df, list(enumerate(quota)), "sentiment int, __need bigint")
    chosen = (
        hash_rank(df, ids, seed, by=["sentiment"], rank_col="__rank")
        .join(limits, "sentiment")
        .withColumn("__in", F.col("__rank") <= F.col("__need"))
        .withColumn("__key", F.struct(hash_key(seed, *ids), *ids))
    )
    last = chosen.filter("__in").agg(F.max("__key").alias("k")).first()["k"]
    overshoot = F.lit(True)
    for name in ids:
        overshoot = overshoot & (F.col(name) == F.lit(last[name]))
    return chosen.select(
        *df.columns, F.when(F.col("__in") & ~overshoot, 1).otherwise(2).alias("part")
    )


def sample_prefix(df: DataFrame, ids: Sequence[str], seed: int, n: int) -> DataFrame:
    """The first ``n`` rows in the seeded random order."""
    return hash_rank(df, ids, seed, rank_col="__rank", keep_first=n).drop("__rank")
