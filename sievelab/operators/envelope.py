"""Elliptic envelope: robust centre and covariance (FAST-MCD, Rousseeuw and Van Driessen 1999).

Rows stay on the executors. Starts are small random subsets, improved on a bounded sample of each group. Each step
after that scans all rows: once or a few times for the distance that bounds the closest share of rows, about the distance
of the step before, and once for the mean and covariance of those rows, for all groups and starts together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelab.operators.latent import truncated_svd
from sievelab.operators.moments import exact_percentile, feature_width, group_moments, stack_rows
from sievelab.operators.ranking import hash_rank
from sievelab.session import cut_lineage, remove, rewritten

RIDGE = 1e-9
#: Rows per group that the starts are drawn from and first improved on (at least ROWS_PER_FEATURE times the width).
SAMPLE_ROWS = 1500
ROWS_PER_FEATURE = 5
#: Random subsets of width + 1 rows per group; the best CANDIDATES of them are carried on with all rows.
SUBSETS = 200
CANDIDATES = 4
#: C-steps never raise the determinant, so they end; a group that still moves after so many is refused.
MAX_STEPS = 1000
DIGIT_BITS = 16
#: Distances that a task holds before it counts them.
HELD = 1 << 19


def chi2_quantile(share: float, freedom: int) -> float:
    """Quantile of the chi-square distribution, by bisection on the incomplete gamma series."""
    a = freedom / 2.0

    def lower(x: float) -> float:
        if x <= 0:
            return 0.0
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1.0
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 0.0, freedom + 20.0 * math.sqrt(2.0 * freedom) + 50.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if lower(mid / 2.0) < share else (lo, mid)
    return (lo + hi) / 2.0


@dataclass
class Ellipse:
    mean: np.ndarray
    inverse: np.ndarray
    log_det: float

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances."""
        centred = x - self.mean
        return ((centred @ self.inverse) * centred).sum(axis=1)


Models = dict[tuple[int, int], Ellipse]
Cuts = dict[tuple[int, int], float]


def _ellipse(n: float, total: np.ndarray, cross: np.ndarray) -> Ellipse:
    mean = total / n
    cov = cross / n - np.outer(mean, mean)
    cov = cov + np.eye(len(mean)) * RIDGE * max(np.trace(cov) / len(mean), 1e-300)
    return Ellipse(mean, np.linalg.pinv(cov, hermitian=True), float(np.linalg.slogdet(cov)[1]))


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, places, matrix) of the rows of each group in a batch."""
    lists = batch.column("features")
    if not pc.all(pc.equal(pc.list_value_length(lists), width), skip_nulls=False).as_py():
        raise ValueError(f"rows that have not {width} features")
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    grp = batch.column("grp").to_numpy(zero_copy_only=False)
    for g in np.unique(grp):
        at = np.flatnonzero(grp == g)
        yield int(g), at, x if len(at) == len(x) else x[at]


def _distances(batch: pa.RecordBatch, models: Models, width: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """((group, start), places, matrix, distances) for every start of the groups in a batch."""
    for g, at, x in _parts(batch, width):
        for key in [k for k in models if k[0] == g]:
            yield key, at, x, np.maximum(models[key].distances(x), 0.0) + 0.0


def _measure(rows: DataFrame, models: Models, width: int) -> DataFrame:
    """(grp, start, row_id, dist) for every start of a row's group."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (g, s), at, _, dist in _distances(batch, models, width):
                yield pa.RecordBatch.from_pydict({
                    "grp": np.full(len(at), g, np.int32), "start": np.full(len(at), s, np.int32),
                    "row_id": batch.column("row_id").take(pa.array(at)), "dist": dist,
                })

    return rows.mapInArrow(measure, "grp int, start int, row_id bigint, dist double")


def _closest(rows: DataFrame, models: Models, cuts: dict, width: int) -> Models:
    """Mean and covariance of the rows within the cut of each (group, start)."""

    def pick(batch: pa.RecordBatch) -> dict:
        return {key: x[dist <= cuts[key]] for key, _, x, dist in _distances(batch, models, width)}

    return {key: _ellipse(*m) for key, m in group_moments(rows, pick, width, arrow=True).items() if m[0] > 0}


def _bits(dist: np.ndarray) -> np.ndarray:
    """The bits of a double that is not negative sort like the double."""
    return dist.view(np.int64)


def _runs(key: tuple, bits: np.ndarray, span: tuple[int, int, int | None]) -> pa.RecordBatch:
    """One row per bin of equal width, in bits, between the ends of the span; what lies outside goes to a bin on its side."""
    low, high, place = span
    bits = np.sort(bits)
    shift = max(0, (high - low).bit_length() - DIGIT_BITS)
    bins = np.clip((bits - low) >> shift, -1, 1 << DIGIT_BITS)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    last = np.append(first[1:], len(bins))
    return pa.RecordBatch.from_pydict({
        "grp": np.full(len(first), key[0], np.int32), "start": np.full(len(first), key[1], np.int32), "bin": bins[first],
        "n": last - first, "low": bits[first], "high": bits[last - 1], "place": pa.array([place] * len(first), pa.int64()),
    })


def _cuts(
    rows: DataFrame, measured: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]], share: float,
    near: dict[tuple[int, int], tuple[float, float]],
) -> Cuts:
    """The distance that the closest ``share`` of rows lies within, per (group, start), at any table size.

    A pass over the rows counts them in at most 2^16 bins per group and start, combined in each task first, and leaves the
    bin of the row sought, until that holds one value only. ``near`` has (distance, width) about which the first pass
    makes its bins; it saves passes where it is right and costs one where it is not.
    """
    whole = (0, int(np.float64(np.inf).view(np.int64)), None)
    spans = {}
    for key, (value, width) in near.items():
        ends = np.array([max(value - width, 0.0), value + width]) + 0.0
        spans[key] = (*map(int, ends.view(np.int64)), None)
    out: Cuts = {}
    while True:
        narrow, settled = dict(spans), set(out)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            waiting = 0
            for batch in batches:
                for key, dist in measured(batch):
                    if key in settled:
                        continue
                    bits = _bits(dist)
                    low, high, place = narrow.get(key, whole)
                    bits = bits if place is None else bits[(bits >= low) & (bits <= high)]
                    if len(bits):
                        held.setdefault(key, []).append(bits)
                        waiting += len(bits)
                if waiting >= HELD:
                    yield from (_runs(k, np.concatenate(v), narrow.get(k, whole)) for k, v in held.items())
                    held, waiting = {}, 0
            yield from (_runs(k, np.concatenate(v), narrow.get(k, whole)) for k, v in held.items())

        key = ["grp", "start"]
        bins = rows.mapInArrow(count, "grp int, start int, bin bigint, n bigint, low bigint, high bigint, place bigint")
        bins = bins.groupBy(*key, "bin").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("place").alias("place")
        )
        upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        wanted = F.greatest(F.ceil(F.lit(share) * F.sum("n").over(Window.partitionBy(*key))), F.lit(1))
        found = (
            bins.withColumn("place", F.coalesce("place", wanted)).withColumn("upto", F.sum("n").over(upto))
            .filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
            .collect()
        )
        spans = {}
        for r in found:
            if r["low"] == r["high"]:
                out[(r["grp"], r["start"])] = float(np.int64(r["low"]).view(np.float64))
            else:
                spans[(r["grp"], r["start"])] = (r["low"], r["high"], r["place"] - r["upto"] + r["n"])
        if not spans:
            return out


def exact_cuts(distances: DataFrame, share: float) -> dict[tuple[int, int], float]:
    """The distance that the closest ``share`` of rows of (grp, start, dist) lies within, per group and start."""

    def measured(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        grp, start, dist = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "start", "dist"))
        for g, s in {*zip(grp.tolist(), start.tolist())}:
            yield (g, s), dist[(grp == g) & (start == s)].astype(float) + 0.0

    return _cuts(distances.select("grp", "start", "dist"), measured, share, {})


def _model_cuts(rows: DataFrame, models: Models, share: float, width: int, near: dict) -> dict[tuple[int, int], float]:
    return _cuts(rows, lambda batch: ((key, dist) for key, _, _, dist in _distances(batch, models, width)), share, near)


def _moments(x: np.ndarray) -> Ellipse:
    return _ellipse(len(x), x.sum(axis=0), x.T @ x)


def _step(x: np.ndarray, model: Ellipse, h: int) -> Ellipse:
    return _moments(x[np.argsort(model.distances(x), kind="stable")[:h]])


def starting_ellipses(x: np.ndarray, support: float, rng: np.random.Generator) -> list[Ellipse]:
    """The best local minima of the determinant over a sample of rows.

    One start is the half nearest to the medians, the others are random subsets of width + 1 rows, so that with fair
    odds some hold good rows only. Each gets two C-steps, the best ones are then run until they settle.
    """
    n, width = x.shape
    h = max(1, math.ceil(support * n))
    centre = np.median(x, axis=0)
    spread = np.median(np.abs(x - centre), axis=0)
    far = (((x - centre) / np.where(spread > 0, spread, 1.0)) ** 2).sum(axis=1)
    tried = [_moments(x[np.argsort(far, kind="stable")[: max(1, (n + 1) // 2)]])]
    tried += [_moments(x[rng.choice(n, min(n, width + 1), replace=False)]) for _ in range(SUBSETS)]
    tried = sorted((_step(x, _step(x, m, h), h) for m in tried), key=lambda m: m.log_det)
    out: list[Ellipse] = []
    for model in tried[: 3 * CANDIDATES]:
        while True:
            better = _step(x, model, h)
            if better.log_det >= model.log_det - 1e-9:
                break
            model = better
        if all(abs(model.log_det - m.log_det) > 1e-9 for m in out):
            out.append(model)
    return sorted(out, key=lambda m: m.log_det)[:CANDIDATES]


def _starts(rows: DataFrame, width: int, support: float, seed: int) -> dict[tuple[int, int], Ellipse]:
    """{(group, start): ellipse} from a seeded sample of each group; one task holds one group's sample."""
    size = max(SAMPLE_ROWS, ROWS_PER_FEATURE * (width + 1))
    sample = hash_rank(rows, ["row_id"], f"{seed}:starts", by=["grp"], keep_first=size)

    def begin(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        g = int(part["grp"].iloc[0])
        found = starting_ellipses(stack_rows(part), support, np.random.default_rng([seed, g & 0xFFFFFFFF]))
        return pd.DataFrame(
            [(g, s, m.mean.tolist(), m.inverse.ravel().tolist(), m.log_det) for s, m in enumerate(found)],
            columns=["grp", "start", "mean", "inverse", "log_det"],
        )

    schema = "grp int, start int, mean array<double>, inverse array<double>, log_det double"
    return {
        (r["grp"], r["start"]): Ellipse(np.array(r["mean"]), np.array(r["inverse"]).reshape(width, width), r["log_det"])
        for r in sample.groupBy("grp").applyInPandas(begin, schema).collect()
    }


def fit_envelope(rows: DataFrame, support: float = 0.8, seed: int = 522) -> dict[int, Ellipse]:
    """Reweighted minimum covariance determinant of each group of (grp, row_id, features).

    The starts come from a bounded sample; every C-step after them, the cuts and the last reweighting go over all rows
    with exact order statistics. Rows are read several times, so pass a written table. Steps go on until no group's
    determinant falls; a group that does not settle is an error.
    """
    width = feature_width(rows)
    before: Cuts = {}
    near: dict[tuple[int, int], tuple[float, float]] = {}

    def step(models: Models) -> Models:
        cuts = _model_cuts(rows, models, support, width, {k: near[k] for k in models if k in near})
        for key, cut in cuts.items():
            moved = abs(cut - before[key]) if key in before else 0.02 * cut
            before[key], near[key] = cut, (cut, 2.0 * moved + 1e-9 * cut)
        return _closest(rows, models, cuts, width)

    models = step(_starts(rows, width, support, seed))
    best: Models = {}
    for (g, s), model in sorted(models.items()):
        if (g, 0) not in best or model.log_det < best[(g, 0)].log_det:
            best[(g, 0)] = model
            first = (g, s)
            near[(g, 0)], before[(g, 0)] = near[first], before[first]
    moving = dict(best)
    for _ in range(MAX_STEPS):
        better = step(moving)
        moving = {k: m for k, m in better.items() if m.log_det < best[k].log_det - 1e-9}
        best |= moving
        if not moving:
            break
    else:
        raise RuntimeError(f"the ellipses of {sorted(g for g, _ in moving)} do not settle")
    medians = _model_cuts(rows, best, 0.5, width, {})
    limit, half = chi2_quantile(0.975, width), chi2_quantile(0.5, width)
    cuts = {key: limit * medians[key] / half for key in best}
    return {g: m for (g, _), m in _closest(rows, best, cuts, width).items()}


def elliptic_envelope(
    df: DataFrame, contamination: float = 0.1, support: float = 0.8, group: str | None = None,
    features: str = "features", seed: int = 522,
) -> DataFrame:
    """(row_id, distance, markasnoise): the farthest ``contamination`` share by Mahalanobis distance,
    overall or within each group."""
    grp: Column = F.lit(0) if group is None else F.col(group).cast("int")
    features = F.col(features).cast("array<double>").alias("features")
    rows = rewritten(df.select(grp.alias("grp"), F.col("row_id").cast("bigint"), features), "envelope")
    models = {(g, 0): m for g, m in fit_envelope(rows, support, seed).items()}
    measured = cut_lineage(
        _measure(rows, models, feature_width(rows)).select("grp", "row_id", F.col("dist").alias("distance"))
    )
    remove(rows)
    cut = exact_percentile(measured, "distance", 1.0 - contamination, by=["grp"])
    flagged = measured.join(F.broadcast(cut), "grp")
    return flagged.select("row_id", "distance", (F.col("distance") > F.col("cut")).cast("int").alias("markasnoise"))


def elliptic_flag_by_class(
    df: DataFrame, r: int, contamination: float = 0.1, support: float = 0.8, label: str = "sentiment"
) -> DataFrame:
    """The envelope inside each class, on the class's own ``r`` latent dimensions (unit rows)."""
    latent = truncated_svd(df, r, label).transform(df, label)
    return elliptic_envelope(latent, contamination, support, label, "latent")
