"""Look-ups of words by blocks of texts: no row per word moves, and odd rows come out as before."""

from pyspark.sql import functions as F

from sievelab.operators import features as ft

TEXTS = "row_id bigint, tokens array<string>"


def dictionary(spark, words):
    return spark.createDataFrame([(w, 1, i) for i, w in enumerate(sorted(words))], "token string, occurrences bigint, term_id int")


def test_few_words_are_shuffled(spark):
    rows = spark.createDataFrame([(i, ["a", "b", "c", "d"] * 200) for i in range(40)], TEXTS)
    known = dictionary(spark, "abcd")
    for out in (ft.drop_rare_tokens(rows), ft.doc2bow(rows, known), ft.encode_fixed_length(rows, known, 50)):
        assert out.count() == 40
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and "collect_list" not in plan
    train = spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "row_id bigint, message string")
    counted = ft.count_vectorize(train, train.union(train), "message", ["bb"])
    assert "Aggregate [row_id" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in counted.collect()} == {(1, "aa", 2), (2, "cc", 2)}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, ["x", None, "a", "a"]), (3, ["z"]), (3, ["a"])], TEXTS)
    assert sorted(map(tuple, ft.drop_rare_tokens(rows).collect())) == [(0, []), (1, []), (2, ["a", "a"]), (3, []), (3, ["a"])]
    bags = sorted((r["row_id"], [tuple(p) for p in r["bow"]]) for r in ft.doc2bow(rows, dictionary(spark, "ax")).collect())
    assert bags == [(0, []), (1, []), (2, [(0, 2), (1, 1)]), (3, [(0, 1)]), (3, [(0, 1)])]
    none = ft.doc2bow(rows, dictionary(spark, "q")).filter(F.size("bow") > 0).count()
    assert none == 0
    ids = sorted((r["row_id"], r["input_ids"]) for r in ft.encode_fixed_length(rows.filter("row_id < 3"), dictionary(spark, "ax"), 6).collect())
    assert ids == [(0, [1, 2, 0, 0, 0, 0]), (1, [1, 2, 0, 0, 0, 0]), (2, [1, 5, 3, 4, 4, 2])]
    nothing = rows.filter("row_id > 9")
    assert ft.drop_rare_tokens(nothing).count() == ft.doc2bow(nothing, dictionary(spark, "a")).count() == 0
