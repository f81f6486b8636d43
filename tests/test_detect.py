"""Neighbours, outliers, latent spaces and scores against brute force and known toys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelab.functions.text import TOPIC_STOP_WORDS, ngrams, word_pattern_tokens
from sievelab.operators import classify, confident, envelope, features as ft, forest, latent, ledger, metrics, moments, neighbors

DOCUMENTS = [
    "Bakers knead dough before sunrise",
    "The river floods every spring and the mill stops",
    "Dough and flour come from the mill",
    "Flour dust fills the old mill by the river",
    "A survey of bridges over the river",
    "Spring repairs of bridges need stone",
    "Stone from the quarry lines the river",
    "Bakers buy flour after the spring survey",
]
SENTENCES = [
    "Rowing is quiet, quiet fun", "Chess is fun", "Rowing needs calm water", "Calm water is great for rowing",
    "I like chess", "Chess needs calm players", "Water is great to watch",
]


def vectors(spark, x, labels=None, **more):
    labels = [0] * len(x) if labels is None else labels
    rows = [(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, sentiment int")


def texts(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "row_id bigint, message string")


def brute_knn(x, labels, k):
    out = {}
    for i in range(len(x)):
        d = [(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(len(x)) if j != i and labels[j] == labels[i]]
        out[i] = [j for _, j in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [16, 64, 8192])
def test_knn_blocks_are_exact(spark, block_rows):
    """A hot group, exact copies and well separated clusters, cut into many blocks and cells."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 4)) * 20
    x = np.concatenate([centres[i % 6] + rng.normal(size=(1, 4)) for i in range(240)])
    x[100:130] = x[100]
    labels = [0 if i % 3 else 1 + i % 2 for i in range(240)]
    df = vectors(spark, x, labels)
    for group, lab in (("sentiment", labels), (None, [0] * 240)):
        got: dict = {}
        for r in neighbors.knn_selfjoin(df, 4, group, block_rows=block_rows).orderBy("row_id", "rank").collect():
            got.setdefault(r["row_id"], []).append(r["neighbor_id"])
        assert got == brute_knn(x, lab, 4)


def test_pivots_rule_out_far_cells(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 3)) + 1000.0 * i for i in range(4)])
    df = vectors(spark, x).select(F.lit(0).alias("grp"), "row_id", "features")
    pivots = neighbors._choose_pivots(df, 10)
    stats = neighbors._cell_stats(neighbors._assign_cells(df, pivots), 3)
    links = neighbors._links(stats, pivots, 3, 10)
    assert len(links) < len(stats) ** 2


def test_sparse_knn(spark):
    rng = np.random.default_rng(2)
    dense = (rng.random((60, 30)) < 0.2) * rng.random((60, 30))
    dense[:, 0] = 1.0
    dense[7] = dense[3]
    dense = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    rows = [(i, [f"t{j}" for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(dense)]
    df = spark.createDataFrame(rows, "row_id bigint, terms array<string>, weights array<double>")
    got: dict = {}
    for r in neighbors.knn_sparse(df, 3, block_rows=13).orderBy("row_id", "rank").collect():
        got.setdefault(r["row_id"], []).append(r["neighbor_id"])
    assert got == brute_knn(dense, [0] * 60, 3)


def test_lof_toy(spark):
    df = vectors(spark, [[-1.1], [0.2], [101.1], [0.3]])
    got = [r["lof"] for r in neighbors.lof_score(df, 2).orderBy("row_id").collect()]
    assert got == pytest.approx([0.9821, 1.0370, 73.37, 0.9821], rel=1e-3)
    flags = [r["markasnoise"] for r in neighbors.lof_flag(df.repartition(3), 2).orderBy("row_id").collect()]
    assert flags == [0, 0, 1, 0]


def test_lof_of_a_lonely_row(spark):
    df = vectors(spark, [[0.0], [1.0], [2.0]], [0, 0, 1])
    assert {r["row_id"]: r["lof"] for r in neighbors.lof_score(df, 2, "sentiment").collect()}[2] == 1.0


def test_envelope_toy(spark):
    df = vectors(spark, [[0, 1], [1, 1], [1, 2], [2, 2], [5, 6]])
    flags = {r["row_id"]: r["markasnoise"] for r in envelope.elliptic_envelope(df, 0.1, 0.8).collect()}
    assert sum(flags.values()) == 1 and flags[4] == 1


def test_envelope_finds_planted_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) @ np.diag([1, 2, 3, 1, 1])
    x[::20] += 25.0
    got = envelope.elliptic_envelope(vectors(spark, x), 0.05, 0.8).filter("markasnoise = 1").collect()
    assert {r["row_id"] for r in got} == set(range(0, 300, 20))


def test_envelope_finds_a_tight_cluster(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5))
    x[:72] = 6.0 + 0.1 * rng.normal(size=(72, 5))
    got = envelope.elliptic_envelope(vectors(spark, x), 0.18, 0.8).filter("markasnoise = 1").collect()
    assert {r["row_id"] for r in got} == set(range(72))


def test_moments_merge_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(moments, "FAN_IN", 2)
    x = np.arange(60.0).reshape(20, 3)
    rows = vectors(spark, x).repartition(9).selectExpr("0 AS grp", "features")
    got = moments.group_moments(rows, lambda b: {(0, 0): moments.stack_rows(b)}, 3)
    n, total, cross = got[(0, 0)]
    assert n == 20 and np.allclose(total, x.sum(axis=0)) and np.allclose(cross, x.T @ x)


def test_exact_cuts(spark):
    rng = np.random.default_rng(12)
    values = np.concatenate([rng.exponential(size=3000), np.full(500, 0.25), np.zeros(40)])
    rows = [(int(i % 2), 0, float(v)) for i, v in enumerate(values)]
    got = envelope.exact_cuts(spark.createDataFrame(rows, "grp int, start int, dist double"), 0.8)
    for g in (0, 1):
        own = np.sort(values[g::2])
        assert got[(g, 0)] == own[int(np.ceil(0.8 * len(own))) - 1]


def test_chi2_quantile():
    assert envelope.chi2_quantile(0.975, 1) == pytest.approx(5.023886, abs=1e-5)
    assert envelope.chi2_quantile(0.5, 10) == pytest.approx(9.341818, abs=1e-5)
    assert envelope.chi2_quantile(0.975, 400) == pytest.approx(457.3055, abs=1e-3)


def test_isolation_forest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[:8] *= 12
    flags = forest.isolation_forest(vectors(spark, x), trees=60, contamination=0.1, tree_batch=25)
    flagged = {r["row_id"] for r in flags.filter("markasnoise = 1").collect()}
    assert len(flagged) == 40 and set(range(8)) <= flagged
    assert forest.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_truncated_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 7))
    model = latent.truncated_svd(vectors(spark, x), 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert model.singular[0] == pytest.approx(s[:3])
    assert np.abs(model.components[0].T @ vt[:3].T) == pytest.approx(np.eye(3), abs=1e-8)
    rows = model.transform(vectors(spark, x)).select("row_id", "latent").collect()
    scores = x @ model.components[0]
    scores /= np.linalg.norm(scores, axis=1, keepdims=True)
    for r in rows:
        assert r["latent"] == pytest.approx(scores[r["row_id"]])


def test_topic_dictionary_toy(spark):
    tokens = ft.drop_rare_tokens(ft.topic_tokens(texts(spark, DOCUMENTS)), 2)
    dictionary = ft.build_dictionary(tokens)
    ids = {r["token"]: r["term_id"] for r in dictionary.collect()}
    words = sorted(w for w in ids)
    assert words == ["bakers", "bridges", "dough", "flour", "from", "mill", "river", "spring", "stone", "survey"]
    assert sorted(ids.values()) == list(range(10))
    query = spark.createDataFrame([(0, ["survey", "flour", "flour", "unknown"]), (1, ["nothing"])], "row_id bigint, tokens array<string>")
    bags = {r["row_id"]: [tuple(p) for p in r["bow"]] for r in ft.doc2bow(query, dictionary).collect()}
    assert bags == {0: sorted([(ids["survey"], 1), (ids["flour"], 2)]), 1: []}


def test_lsa_toy(spark):
    stop = ["is", "for", "to", "too", "like", "great"]
    rows = latent.analysis_terms(texts(spark, SENTENCES), "message", stop)
    model = latent.lsa_fit(rows, 2)
    terms = {r["term"]: np.array(r["vec"]) for r in model.terms.collect()}
    names = sorted(terms)
    lines = [[t for t in r["terms"]] for r in rows.orderBy("row_id").collect()]
    matrix = np.array([[line.count(t) for t in names] for line in lines], dtype=float)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert model.singular == pytest.approx(s[:2], abs=1e-6)
    want = latent.fix_signs(vt[:2].T)
    assert np.array([terms[t] for t in names]) == pytest.approx(want, abs=1e-6)
    query = latent.analysis_terms(texts(spark, ["fun chess", "nothing known"]), "message", stop)
    got = {r["row_id"]: r["latent"] for r in latent.fold_in(query, model.terms, model.singular, "scaled").collect()}
    q = np.array([1.0 if t in ("fun", "chess") else 0.0 for t in names])
    assert got[0] == pytest.approx(q @ want @ np.diag(s[:2]), abs=1e-6) and got[1] == [0.0, 0.0]


def test_tfidf_forms_agree(spark):
    df = texts(spark, DOCUMENTS + SENTENCES)
    terms = ngrams(word_pattern_tokens("message"), 1, 2)
    long = {(r["row_id"], r["term"]): r["weight"] for r in ft.tfidf(df, df, terms).collect()}
    rows = df.withColumn("terms", terms)
    model = ft.fit_tfidf_pipeline(rows)
    words = model.stages[0].vocabulary
    for r in model.transform(rows).select("row_id", "features").collect():
        for i, v in zip(r["features"].indices, r["features"].values):
            assert long.pop((r["row_id"], words[i])) == pytest.approx(v)
    assert not long


def test_encode_cuts_and_pads(spark):
    df = spark.createDataFrame([(0, ["a", "b", "z"]), (1, ["a"] * 9), (2, [])], "row_id bigint, tokens array<string>")
    dictionary = spark.createDataFrame([("a", 2, 0), ("b", 1, 1)], "token string, occurrences bigint, term_id int")
    got = {r["row_id"]: (r["input_ids"], r["attention_mask"]) for r in ft.encode_fixed_length(df, dictionary, 6).collect()}
    assert got[0] == ([1, 4, 5, 3, 2, 0], [1, 1, 1, 1, 1, 0])
    assert got[1] == ([1, 4, 4, 4, 4, 2], [1] * 6)
    assert got[2] == ([1, 2, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])


def test_metrics_toy(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (2, 2)]
    df = spark.createDataFrame(pairs, "y_true int, y_pred int")
    counts = metrics.label_counts(df, [0, 1, 2, 3])
    zero = {r["label"]: r for r in metrics.class_prf(counts).collect()}
    one = {r["label"]: r for r in metrics.class_prf(counts, zero_division=1.0).collect()}
    assert (zero[3]["f1"], one[3]["f1"]) == (0.0, 1.0)
    assert zero[1]["precision"] == pytest.approx(2 / 3) and zero[1]["recall"] == 1.0
    row = metrics.micro_macro_weighted(counts).first()
    assert row["micro_f1"] == pytest.approx(4 / 6)
    assert row["macro_f1"] == pytest.approx((0.5 + 0.8 + 2 / 3) / 3)
    assert row["f1_of_classes"] == [0.5, 0.8, 0.667, 0.0]
    matrix = {r["y_true"]: [r[f"c{i}"] for i in range(4)] for r in metrics.confusion_matrix(df, [0, 1, 2, 3]).collect()}
    assert matrix == {0: [1, 1, 0, 0], 1: [0, 2, 0, 0], 2: [1, 0, 1, 0], 3: [0, 0, 0, 0]}


def test_best_epoch_takes_the_first_of_the_best(spark):
    rng = np.random.default_rng(6)
    rows = [(f"r{i}", e, float(rng.integers(5)) / 5) for i in range(8) for e in range(12)] + [("n", 0, None), ("n", 1, 0.1), ("n", 2, None)]
    df = spark.createDataFrame(rows, "run string, epoch int, val_accuracy double")
    want = {}
    for run, epoch, acc in rows:
        if acc is not None and acc > want.get(run, (None, -1.0))[1]:
            want[run] = (epoch, acc)
    assert {r["run"]: (r["best_epoch"], r["best_val_accuracy"]) for r in ledger.best_epoch(df).collect()} == want


def test_block_lines_cut_toward_zero(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(1, 28)], "experiment int, macro_f1 double")
    lines = ledger.series(df, "experiment", "macro_f1", ledger.block_lines()).collect()
    count: dict = {}
    for r in lines:
        count[r["line"]] = count.get(r["line"], 0) + 1
    assert count == {"Original Data": 7, **{name: 4 for name in ledger.NOISE_LINES}}


def noisy_blobs(spark, n=240, k=3):
    rng = np.random.default_rng(7)
    labels = np.arange(n) % k
    x = np.eye(k)[labels] * 4 + rng.normal(size=(n, k)) * 0.3
    given = labels.copy()
    given[::12] = (labels[::12] + 1) % k
    return vectors(spark, x, given), labels


def test_confident_learning_finds_moved_labels(spark):
    df, truth = noisy_blobs(spark)
    scored = confident.centroid_oof_probabilities(df)
    joint = confident.confident_joint(scored)
    errors = {r["row_id"] for r in confident.find_label_errors(scored, joint).collect()}
    assert errors == set(range(0, 240, 12))
    rates = confident.noise_rate_matrix(joint).groupBy("given").agg(F.sum("p_true_given").alias("s")).collect()
    assert [r["s"] for r in rates] == pytest.approx([1.0] * 3)


def test_svm_rules_and_calibration(spark):
    df, truth = noisy_blobs(spark)
    clean = df.withColumn("sentiment", (F.col("row_id") % 3).cast("int"))
    rows = classify.with_vectors(clean)
    svm = classify.fit_ovr_svm(rows, iterations=15)
    one = svm.predict_one(rows)
    assert one.filter("y_pred = sentiment").count() == 240
    assert svm.predict_hot(rows).filter(F.size("hot_pred") == 3).count() == 240
    probs = classify.calibrate_sigmoid(rows, folds=2, iterations=5).probabilities(rows)
    assert probs.filter(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).count() == 240


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_kernel_svm_learns_rings(spark, kernel):
    rng = np.random.default_rng(8)
    angle, radius = rng.random(200) * 2 * np.pi, np.where(np.arange(200) % 2, 1.0, 3.0)
    x = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1)
    df = vectors(spark, np.concatenate([x, x**2], axis=1) if kernel == "poly" else x, np.arange(200) % 2)
    model = classify.fit_kernel_svm(df, kernel, landmarks=40)
    assert model.predict_one(df).filter("y_pred = sentiment").count() >= 190


def test_stop_words_are_a_list():
    assert len(TOPIC_STOP_WORDS) == 7
