"""Quality classifier from positives and unlabelled text (non-negative PU learning).

Trusted positives are labelled rows; all other text counts as unlabelled, whatever its label. The class prior is the
least ratio of the two groups' shares above a score (best bin), from scores by models that have not seen the row. A
linear model over binned text ratios minimises
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``; where the second part turns negative, its gradient is reversed.
The score is 0.5 where a share of ``LOST`` of the positives, scored by models that have not seen them, falls below.

The model is fitted on the driver from at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled rows, those with the
least hash of their id. Scores are one Spark expression over counts of the whole text.

Defined results: null and empty texts have counts of 0 and are scored by them; repeated rows get equal scores; rows with
a null id are scored but never learnt from; without positives every score is 0.5; an empty table gives an
empty table; extra columns are left out. Language, source, id and labels are not inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import pick, spread
from sievelab.llm.textstats import text_counts

SAMPLE = 20_000
BINS = 12
STEPS = 400
#: Folds of the scores that set the prior and the margin, and the decay of the prior's models.
FOLDS = 5
PRIOR_DECAY = 1e-2
#: Times that the folds are dealt; scores and weights are averaged.
DEALS = 3
#: Share of the positives that may be rejected.
LOST = 0.01
#: From this upper bound of the prior on, the unlabelled rows may all be positive.
ALL_POSITIVE = 0.99

#: Ratios over the counts of ``text_counts``; 0 where there is nothing to divide by.
FEATURES = {
    "size": "ln(1 + n_words)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0)",
    "symbols": "coalesce(try_divide(n_symbols, n_words), 0)",
    "marks": "coalesce(try_divide(n_marks, n_words), 0)",
    "bars": "coalesce(try_divide(n_bars, n_words), 0)",
    "capitals": "coalesce(try_divide(n_caps, n_words), 0)",
    "runs": "coalesce(try_divide(n_runs, n_words), 0)",
    "variety": "coalesce(ln(1 + n_distinct) / ln(2 + n_words), 0)",
    "dup_lines": "coalesce(try_divide(n_dup_lines, n_lines), 0)",
    "repeats": "coalesce(try_divide(n_repeat_words, n_words), 0)",
    "stops": "coalesce(try_divide(n_stop, n_words), 0)",
}


@dataclass
class Model:
    """Weights of the bins of each feature; ``edges`` are the bins' upper ends, the last bin is open."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    prior: float

    def margin(self) -> Column:
        total = F.lit(float(self.bias))
        for name, edges, weights in zip(FEATURES, self.edges, self.weights):
            value = F.col(f"__{name}")
            if len(edges):
                case = F.when(value <= float(edges[0]), float(weights[0]))
                for edge, weight in zip(edges[1:], weights[1:]):
                    case = case.when(value <= float(edge), float(weight))
                total = total + case.otherwise(float(weights[-1]))
            else:
                total = total + F.lit(float(weights[0]))
        return total


def _features(docs: DataFrame) -> DataFrame:
    counted = text_counts(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    return counted.withColumns({f"__{k}": F.expr(v) for k, v in FEATURES.items()})


def _one_hot(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    columns = [np.eye(len(e) + 1)[np.searchsorted(e, values[:, i], side="left")] for i, e in enumerate(edges)]
    return np.concatenate(columns, axis=1) if columns else np.zeros((len(values), 0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def risk(scores: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, loss: str) -> np.ndarray:
    """Non-negative risk of each column of ``scores`` (margins): prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
    ``p`` and ``u`` weigh rows as positives and as unlabelled ones, columns adding up to 1. Losses: ``log`` and ``sigmoid``."""
    right, wrong = _losses(scores, loss)
    return prior * (p * right).sum(axis=0) + np.maximum(0, (u * wrong).sum(axis=0) - prior * (p * wrong).sum(axis=0))


def _losses(scores: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row if it is positive and if it is not."""
    if loss == "sigmoid":
        s = _sigmoid(scores)
        return 1 - s, s
    return np.logaddexp(0, -scores), np.logaddexp(0, scores)


def slope(scores: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, loss: str) -> np.ndarray:
    """Derivative by each score along which a step is taken: that of the risk, or, where the bracket is negative, away from it
    by the bracket's own (the rule that keeps the estimator from overfitting)."""
    s = _sigmoid(scores)
    if loss == "sigmoid":
        bracket = ((u - prior * p) * s).sum(axis=0)
        up = s * (1 - s)
        right, rest = -p * up, (u - prior * p) * up
    else:
        bracket = ((u - prior * p) * np.logaddexp(0, scores)).sum(axis=0)
        right, rest = -p * (1 - s), (u - prior * p) * s
    return np.where(bracket >= 0, rest + prior * right, -rest)


def _fit(x: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None, start: np.ndarray | None = None, strength: float = 1e-3) -> np.ndarray:
    """One model per column of the row weights ``p`` and ``u``, all fitted together: weights and, last, the bias. Without a prior: plain
    logistic regression of the two groups. With a ``start``: the bounded sigmoid loss, on which a slip of the prior weighs
    little, from those weights on; else the log loss."""
    w = np.zeros((x.shape[1], p.shape[1]), np.float32) if start is None else start
    first, second = np.zeros_like(w), np.zeros_like(w)
    decay = np.append(np.full(len(w) - 1, strength, np.float32), 0)[:, None].astype(np.float32) * (1 if start is None else 0.01)
    for step in range(1, STEPS + 1):
        scores = x @ w
        if prior is None:
            s = _sigmoid(scores)
            by_score = u * s - p * (1 - s)
        else:
            by_score = slope(scores, p, u, prior, "log" if start is None else "sigmoid")
        grad = x.T @ by_score.astype(np.float32, copy=False) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[float, float]:
    """Share of positives in the unlabelled rows, from scores of rows that the scoring model has not seen, and
    its upper bound with slack for the size of the group. The best bin holds most positives and has the least ratio
    with one standard error on top."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.2, 41)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(u * (1 - u) / len(unlabelled) + (u / p) ** 2 * p * (1 - p) / len(positive) + 1 / len(unlabelled) ** 2)
    best = np.argmin((u + error) / p)
    slack = np.sqrt(np.log(40) / 2 / len(unlabelled))
    point, upper = u[best] / p[best], (u[best] + slack) / p[best]
    return float(np.clip(point, 0.01, 0.995)), float(min(upper, 1.0))


def _folds(is_p: np.ndarray, is_u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row and model, models being deals x folds: whether the row is left out of it, and its weights as a positive and as an
    unlabelled row. A single positive is in every fold."""
    folds = min(FOLDS, int(is_p.sum()))
    rng = np.random.default_rng(5)
    left_out, p, u = [], [], []
    for _ in range(DEALS):
        fold = np.zeros(len(is_p), int)
        for group in (is_p, ~is_p):
            fold[group] = rng.permutation(int(group.sum())) % folds
        for k in range(folds):
            rest = fold != k if folds > 1 else np.ones(len(is_p), bool)
            own_p, own_u = rest & is_p, rest & is_u if (rest & is_u).any() else is_u
            left_out.append(fold == k)
            p.append(own_p / own_p.sum())
            u.append(own_u / own_u.sum())
    return np.array(left_out).T, np.array(p, np.float32).T, np.array(u, np.float32).T


def _unseen(x: np.ndarray, w: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Scores of all rows, each the mean of those by the models that it is left out of."""
    return ((x @ w) * left_out).sum(axis=1, dtype=float) / left_out.sum(axis=1)


def learn_from(values: np.ndarray, is_p: np.ndarray, is_u: np.ndarray) -> Model:
    """The model of rows of features, of which some are positives, some unlabelled, or both."""
    mix = np.concatenate([values[is_p], values[is_u]])
    edges = []
    for i in range(len(FEATURES)):
        cuts = np.unique(np.concatenate([np.quantile(mix[:, i], np.linspace(0.02, 0.98, BINS - 2)), np.quantile(values[is_u, i], [0.9, 0.99])]))
        edges.append(cuts[cuts < mix[:, i].max()])
    x = np.hstack([_one_hot(values, edges), np.ones((len(values), 1))]).astype(np.float32)
    left_out, p, u = _folds(is_p, is_u)
    seen = _unseen(x, _fit(x, p, u, None, strength=PRIOR_DECAY), left_out)
    prior, _ = estimate_prior(seen[is_p], seen[is_u])
    each = _fit(x, p, u, prior, _fit(x, p, u, prior))
    unseen, w = _unseen(x, each, left_out), each.mean(axis=1, dtype=float)
    # equal texts may score less by the mean model than in the folds; the last bit covers the rounding of sums
    margin = min(np.quantile(x[is_p] @ w, LOST), np.quantile(unseen[is_p], LOST)) - 1e-3
    sizes = np.cumsum([len(e) + 1 for e in edges])[:-1]
    return Model(edges, np.split(w[:-1], sizes), float(w[-1] - margin), prior)


def fit(docs: DataFrame, positives: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """A model from rows for which ``learn`` (an expression of ``doc_id``) holds.

    ``positives`` has the ids of trusted rows as ``doc_id``. None if there are no positives or no rows.
    """
    rows = pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col).withColumn("mark", F.xxhash64("text"))
    order = F.xxhash64("doc_id", "mark", F.lit("pu"))
    # an id may have many rows and a row many copies: distinct rows are drawn
    marks = rows.filter(F.col("doc_id").isNotNull() & learn).groupBy("doc_id", "mark").agg(F.lit(1).alias("one")).drop("one")
    trusted = marks.join(positives.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = (
        trusted.sort(order, "doc_id", "mark").limit(sample).withColumn("trusted", F.lit(True))
        .unionByName(marks.sort(order, "doc_id", "mark").limit(sample).withColumn("trusted", F.lit(False)))
    )
    groups = chosen.groupBy("doc_id", "mark").agg(F.collect_set("trusted").alias("groups"))
    # at most two samples of rows
    found = (
        _features(rows.join(F.broadcast(groups), ["doc_id", "mark"]))
        .select("doc_id", "mark", "groups", *[f"__{k}" for k in FEATURES])
        .dropDuplicates(["doc_id", "mark"])
        .toPandas()
        .sort_values(["doc_id", *[f"__{k}" for k in FEATURES]], kind="stable")
    )
    values = found[[f"__{k}" for k in FEATURES]].to_numpy(float)
    is_p = np.array([True in g for g in found.groups], bool)
    is_u = np.array([False in g for g in found.groups], bool)
    if not is_p.any() or not is_u.any():
        return None
    return learn_from(values, is_p, is_u)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted."""
    rows = spread(pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col), "doc_id")
    if model is None:
        out = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:
        out = _features(rows).select("doc_id", (F.lit(1.0) / (1 + F.exp(-model.margin()))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model takes for good, with their columns."""
    if model is None:
        return docs
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return _features(packed).filter(model.margin() >= 0).select(*[F.col("row")[c].alias(c) for c in names])
