"""TF-IDF by blocks of texts: entries of a text never move as rows, and odd rows come out as by hand."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievelab.operators import features as ft

ROWS = [(1, ["a", "b", "a", None]), (2, ["a"]), (3, []), (4, None), (5, ["x", "b"]), (5, ["b", "q"]), (None, ["a", "b"]), (6, ["unknown"])]


def by_hand(rows, known, n, sublinear):
    counts = defaultdict(Counter)
    for key, terms in rows:
        counts[key].update(t for t in terms or [] if t in known)
    out = {}
    for key, own in counts.items():
        w = {t: (1 + math.log(c) if sublinear else c) * (math.log((1 + n) / (1 + known[t])) + 1) for t, c in own.items()}
        out |= {(key, t): v / math.sqrt(sum(x * x for x in w.values())) for t, v in w.items()}
    return out


@pytest.mark.parametrize("tokens", [1, 3, 1 << 20])
@pytest.mark.parametrize("sublinear", [False, True])
def test_weights_by_blocks(spark, monkeypatch, tokens, sublinear):
    monkeypatch.setattr(ft, "BLOCK_TOKENS", tokens)
    rows = spark.createDataFrame(ROWS, "row_id long, terms array<string>")
    train = rows.filter("row_id < 6")
    got = ft.tfidf(train, rows, F.col("terms"), sublinear)
    known = {"a": 2, "b": 3, "x": 1, "q": 1}
    assert {(r.row_id, r.term): r.weight for r in got.collect()} == pytest.approx(by_hand(ROWS, known, 6, sublinear))
    assert not ft.tfidf(train, rows.filter("row_id > 9"), F.col("terms")).count()


def test_entries_do_not_move_as_rows(spark):
    rows = spark.createDataFrame([(i, "one two three " * 50) for i in range(400)], "row_id long, message string")
    out = ft.tfidf(rows, rows, ft.bigram_terms("message"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [row_id" not in plan
    assert out.count() == 400 * 6
