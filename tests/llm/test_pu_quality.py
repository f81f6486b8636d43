import numpy as np
from pyspark.sql import functions as F

from sievelab.llm import pu_quality as m
from sievelab.llm.common import table
from sievelab.llm.q_pu_quality import pu_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    rows = pu_quality(spark, SF).join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3
    assert all(0 <= r.score <= 1 for r in rows)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(4)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(m.estimate_prior(p, u)[0] - 0.7) < 0.05
    assert m.estimate_prior(p, rng.normal(2, 1, 4000))[1] >= m.ALL_POSITIVE


def test_odd_rows_and_missing_labels(spark):
    schema = "doc_id long, text string, score string, predicted string, __size int"
    rows = [(1, None, "c", "c", 1), (2, "", "c", "c", 1), (None, "a b c", "c", "c", 1), (3, "the of " * 30_000, "c", "c", 1), (3, "x", "c", "c", 1)]
    df = spark.createDataFrame(rows, schema)
    ids = spark.createDataFrame([(3,), (None,)], "doc_id long")
    model = m.fit(df, ids, F.lit(True))
    out = m.scored(df, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert m.keep_good(df, model).columns == df.columns
    none = m.fit(df, ids.limit(0), F.lit(True))
    assert none is None and [r.score for r in m.scored(df, none).collect()] == [0.5] * 5
    empty = spark.createDataFrame([], schema)
    assert m.scored(empty, m.fit(empty, ids, F.lit(True))).count() == 0


def test_a_little_junk_that_passes_the_rules_is_rejected(spark):
    from sievelab.llm.quality_rules import keep_by_rules

    rng = np.random.default_rng(8)
    common = "the of and to in is that it was for on with as at by".split()
    rare = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(4, 9))) for _ in range(3000)]
    clean = lambda: " ".join(str(rng.choice(common if rng.random() < 0.4 else rare)) for _ in range(rng.integers(30, 120)))
    junk = lambda: " ".join(str(w) + "".join(rng.choice(list("xqzjk"), 5)) for w in rng.choice(rare, rng.integers(30, 120)))
    rows = [(i, junk() if i % 25 == 0 else clean()) for i in range(300)]
    docs = keep_by_rules(spark.createDataFrame(rows, "doc_id long, text string"))
    trusted = spark.createDataFrame([(i,) for i in range(300) if i % 25 and i % 3 == 0], "doc_id long")
    out = {r.doc_id: r for r in m.scored(docs, m.fit(docs, trusted, F.lit(True))).collect()}
    bad, good = ([r for i, r in out.items() if (i % 25 == 0) == kind] for kind in (True, False))
    assert len(bad) >= 8 and len(good) > 270
    assert max(r.score for r in bad) < np.median([r.score for r in good]) and not any(r.predicted for r in bad)
    assert np.mean([r.predicted for r in good]) > 0.95


def test_risk_and_slope_against_loops_and_differences():
    rng = np.random.default_rng(6)
    scores, prior = rng.normal(size=(9, 4)), 0.4
    p, u = rng.random((9, 4)) * (np.arange(9) < 5)[:, None], rng.random((9, 4)) * (np.arange(9) > 2)[:, None]
    # in the last two columns the positives look like the other class, so the bracket is below zero
    scores[:5, 2:] += 6
    scores[5:, 2:] -= 6
    p, u = p / p.sum(axis=0), u / u.sum(axis=0)
    losses = {"log": (lambda z: np.log(1 + np.exp(-z)), lambda z: np.log(1 + np.exp(z))), "sigmoid": (lambda z: 1 / (1 + np.exp(z)), lambda z: 1 / (1 + np.exp(-z)))}
    for name, (right, wrong) in losses.items():
        plus = [sum(p[i, j] * right(scores[i, j]) for i in range(9)) for j in range(4)]
        rest = [sum((u[i, j] - prior * p[i, j]) * wrong(scores[i, j]) for i in range(9)) for j in range(4)]
        assert np.allclose(m.risk(scores, p, u, prior, name), [prior * a + max(0, b) for a, b in zip(plus, rest)])
        assert min(rest) < 0 < max(rest)
        got = m.slope(scores, p, u, prior, name)
        for i in range(9):
            for j in range(4):
                h = 1e-6
                d_right = (right(scores[i, j] + h) - right(scores[i, j] - h)) / (2 * h)
                d_wrong = (wrong(scores[i, j] + h) - wrong(scores[i, j] - h)) / (2 * h)
                d_rest = (u[i, j] - prior * p[i, j]) * d_wrong
                assert np.isclose(got[i, j], prior * p[i, j] * d_right + d_rest if rest[j] >= 0 else -d_rest, atol=1e-6)


def test_the_sample_bounds_rows_whatever_the_ids(spark):
    rows = [(1 if i % 2 else i, f"word{i} and the rest of it " * (1 + i % 7)) for i in range(400)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,), (4,)], "doc_id long")
    sizes = []
    real = m.learn_from
    try:
        m.learn_from = lambda v, p, u: sizes.append((len(v), int(p.sum()), int(u.sum())))
        m.fit(docs, ids, F.lit(True), sample=50)
    finally:
        m.learn_from = real
    assert sizes[0][1:] == (50, 50) and sizes[0][0] <= 100
