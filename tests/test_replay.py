"""The replay of training callbacks against a plain loop, and the query's full set of columns."""

import numpy as np

import __spark_entry__ as entry
from sievelab.operators import ledger


def replay(points, patience, lr, min_delta=1e-4, min_lr=1e-6):
    best, best_epoch, wait, low, cuts = -np.inf, None, 0, np.inf, []
    for epoch, acc, loss in points:
        wait = 0 if acc > best else wait + 1
        if acc > best:
            best, best_epoch = acc, epoch
        if loss < low - min_delta:
            low = loss
        elif lr > min_lr:
            cuts.append(epoch)
            lr = max(lr * 0.1, min_lr)
        if wait >= patience:
            return best_epoch, epoch, cuts
    return best_epoch, None, cuts


def test_callbacks_are_replayed_in_order(spark):
    rng = np.random.default_rng(6)
    runs = {f"r{i}": [(e, float(rng.random()), float(rng.random())) for e in range(12)] for i in range(8)}
    rows = [(r, e, a, x) for r, points in runs.items() for e, a, x in points]
    df = spark.createDataFrame(rows, "run string, epoch int, val_accuracy double, val_loss double").repartition(5)
    for r in ledger.replay_callbacks(df, patience=3).collect():
        assert (r["best_epoch"], r["stop_epoch"], r["lr_cuts"]) == replay(runs[r["run"]], 3, 1e-4)


def test_query_gives_stop_and_cuts(spark):
    found = entry.queries()["best_epoch"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["run", "best_epoch", "best_val_accuracy", "stop_epoch", "lr_cuts", "final_lr"]
    assert found.filter("stop_epoch is not null").count() > 0
