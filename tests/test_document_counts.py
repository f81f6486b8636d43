"""Document counts are made on the map side."""

from pyspark.sql import functions as F

from sievelab.operators.features import document_counts, fit_term_weights, tfidf


def test_term_rows_are_counted_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, ["a"]), (3, []), (4, None)], "row_id long, terms array<string>")
    counts = document_counts(rows, "terms")
    assert {r.term: r.df for r in counts.collect()} == {"a": 2, "b": 1}
    weighed = tfidf(rows, rows, F.col("terms"))
    for df in (counts, fit_term_weights(rows).idf):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 0
    assert weighed._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert {(r.row_id, r.term): round(r.weight, 6) for r in weighed.filter("row_id = 2").collect()} == {(2, "a"): 1.0}
