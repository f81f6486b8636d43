"""Feature rows of a grid's run: the long form gives the same, and texts are taken apart once."""

from pyspark.sql import functions as F

from sievelab.functions.text import word_pattern_tokens
from sievelab.operators import features as ft
from sievelab.plans import study


def test_config_rows_take_texts_apart_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    texts = ["aa bb bb cc", "aa bb dd", "aa ee bb bb bb", "dd dd ee", "!!", "cc cc ff"]
    raw = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "row_id long, message string, sentiment int")
    marked = raw.withColumn("message", F.udf(read, "string")("message"))
    test = spark.createDataFrame([(10, "aa aa bb zz", 0), (11, "zz", 1)], "row_id long, message string, sentiment int")
    train_rows, test_rows, width = study._config_rows(marked, test, study._config_counts(test), 2)
    assert seen.value == len(texts)
    terms = word_pattern_tokens("message")
    numbers = {t: i for i, t in enumerate(["aa", "bb", "cc", "dd", "ee"])}
    assert width == len(numbers)
    for rows, found in ((raw, train_rows), (test, test_rows)):
        expected = {}
        for r in ft.tfidf(raw, rows, terms, sublinear=True, min_df=2, max_df=0.8).collect():
            expected.setdefault(r.row_id, {})[numbers[r.term]] = round(r.weight, 12)
        got = {r.row_id: r for r in found.collect()}
        assert len(got) == rows.count()
        for i, r in got.items():
            assert list(r.term_ids) == sorted(r.term_ids)
            assert {a: round(b, 12) for a, b in zip(r.term_ids, r.weights)} == expected.get(i, {})
