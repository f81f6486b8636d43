"""A cleaned labelled corpus cut into regions, with its noise pool."""

from __future__ import annotations

import copy
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sievelab.operators import cleaning, noise, sampling
from sievelab.operators.features import normalized_text
from sievelab.session import cut_lineage

SEED = 522
REGION_PERCENT = {"train": 60, "test": 12, "validation": 6, "noise": 22}


def clean_messages(messages: DataFrame) -> DataFrame:
    """Shifted labels, no nulls, the first row of each message and of each tweetid."""
    rows = cleaning.drop_null_rows(cleaning.recode_label(messages))
    rows = cleaning.dedup_first(rows, ["message"], "row_id")
    return cleaning.dedup_first(rows, ["tweetid"], "row_id")


def _normalize(rows: DataFrame) -> DataFrame:
    return normalized_text(rows).withColumn("message", F.col("normalized")).drop("normalized")


class Corpus:
    """Regions and noise of one labelled message table.

    The clean table and the table with regions are each written once, since every split, pool and mix
    reads them; class counts (k numbers) are the only thing on the driver.
    ``sizes`` gives rows per region; without it the regions take fixed percentages.
    """

    def __init__(
        self, messages: DataFrame, sizes: dict[str, int] | None = None, seed: int = SEED, k: int | None = None
    ):
        self.seed = seed
        self.raw = messages
        self.clean = cut_lineage(clean_messages(messages))
        counts = sampling.count_classes(self.clean, k)
        self.k = len(counts)
        if sizes is None:
            sizes = {r: sum(counts) * pct // 100 for r, pct in REGION_PERCENT.items()}
        self.plan = sampling.SplitPlan(counts, sizes)
        self.ranked = sampling.seeded_shuffle(self.clean, ["row_id"], seed)
        self._regions = None
        self._pool = None

    @property
    def regions(self) -> DataFrame:
        if self._regions is None:
            self._regions = cut_lineage(sampling.stratified_regions(self.ranked, self.plan))
        return self._regions

    def subset(self, region: str, size: int | None = None, shares: Sequence[float] | None = None) -> DataFrame:
        rows = sampling.subset_with_distribution(self.regions, self.plan, region, size, shares)
        return cleaning.tag_noise(rows.select("row_id", "message", "sentiment", "tweetid"), "none")

    def train(self, size=None, shares=None) -> DataFrame:
        return self.subset("train", size, shares)

    def test(self, size=None, shares=None) -> DataFrame:
        return self.subset("test", size, shares)

    def validation(self, size=None, shares=None) -> DataFrame:
        return self.subset("validation", size, shares)

    def mislabeled(self, size: int | None = None) -> DataFrame:
        """Rows of the noise region with wrong labels."""
        rows = self.subset("noise", size).drop("noise", "noise_text")
        return noise.inject_mislabel(rows, self.seed, self.k).select(*noise.POOL_COLUMNS)

    def add_unlabelled(
        self, source: str, rows: DataFrame, shares: Sequence[float] | None = None, size=None, alone: bool = False
    ):
        """Add a source without labels; labels follow ``shares`` or the corpus' own.

        With ``alone`` the source replaces the pool instead of joining it.
        """
        labelled = noise.label_unlabelled_pool(rows, self.plan.shares if shares is None else shares)
        self._add(noise.clean_noise_pool(labelled, source, self.seed, size), alone)

    def add_labelled(self, source: str, rows: DataFrame, ratio: float = 0.0, size=None, alone: bool = False):
        """Add a source with raw labels and ids, of which the share ``ratio`` gets wrong labels."""
        shifted = cleaning.recode_label(rows)
        corrupted = noise.mislabel_ratio_pool(shifted, ratio, self.seed, self.k)
        outside = noise.exclude_test_overlap(corrupted, self.test(), self.seed)
        self._add(noise.clean_noise_pool(outside, source, self.seed, size), alone)

    def _add(self, part: DataFrame, alone: bool) -> None:
        self._pool = noise.union_noise_pool(*([] if alone else [self.pool.drop("noise")]), part)

    @property
    def pool(self) -> DataFrame:
        if self._pool is None:
            self._pool = noise.union_noise_pool(self.mislabeled())
        return self._pool

    def write_pool(self) -> DataFrame:
        """Write the pool once, so that its counts and its samples come from the same rows."""
        self._pool = cut_lineage(self.pool)
        return self._pool

    def reset_pool(self) -> None:
        self._pool = None

    def noisy_train(self, original: int | None, noisy: int, shares=None) -> DataFrame:
        return noise.mix_noisy_train(self.train(original, shares), self.pool, noisy, self.seed)

    def normalized(self) -> Corpus:
        """The same corpus with normalised, stemmed text in ``message``, made and written once, so that
        no experiment repeats it. Splits and noise follow ids and stay the same."""
        other = copy.copy(self)
        other._regions = cut_lineage(_normalize(self.regions))
        other._pool = cut_lineage(_normalize(self.pool))
        return other

    def labels(self) -> list[int]:
        return list(range(self.k))

    def summary(self) -> DataFrame:
        from sievelab.operators.summaries import dataset_summary

        return dataset_summary(self.regions, self.pool, self.labels(), self.raw).orderBy(
            F.desc("section"), "item"
        )
