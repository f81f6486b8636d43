"""The cuts of the envelope: exact whatever the guess, and few jobs a step."""

import numpy as np
import pyarrow as pa

from sievelab.operators import envelope


def test_cuts_do_not_depend_on_the_guess(spark):
    values = np.sort(np.concatenate([np.random.default_rng(8).exponential(size=900), np.full(100, 0.5)]))
    rows = spark.createDataFrame([(float(v),) for v in values], "dist double").repartition(4)

    def measured(batch: pa.RecordBatch):
        yield (0, 0), batch.column("dist").to_numpy(zero_copy_only=False)

    right = values[799]
    for near in ({}, {(0, 0): (right, 1e-3)}, {(0, 0): (0.01, 1e-3)}, {(0, 0): (50.0, 1.0)}):
        assert envelope._cuts(rows, measured, 0.8, near) == {(0, 0): right}


def test_jobs_of_a_fit(spark):
    x = np.random.default_rng(9).normal(size=(3000, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, features array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("envelope-jobs", "")
    try:
        flags = envelope.elliptic_envelope(rows, 0.1)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("envelope-jobs"))
    assert jobs < 95
    assert flags.filter("markasnoise = 1").count() == 300
