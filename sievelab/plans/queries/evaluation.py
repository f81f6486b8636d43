"""Scores, reports, the experiment ledger and training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelab.functions.vectors import class_means, distances_to
from sievelab.functions.text import one_hot
from sievelab.operators import classify, ledger as lg, metrics as mt
from sievelab.operators.summaries import distribution_string
from sievelab.plans import views
from sievelab.plans.oracle import sql

LABELS = list(range(10))
SCORES = ["micro_f1", "macro_f1", "weighted_f1", "macro_precision", "macro_recall"]


def _round(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


def _list(df: DataFrame, name: str = "f1_of_classes") -> DataFrame:
    """The score list as text with three decimals."""
    text = F.concat_ws(",", F.transform(name, lambda x: F.format_string("%.3f", x)))
    return df.withColumn(name, text)


def q_class_weights(spark, sf):
    return _round(classify.class_weights(views.vectors(spark, sf)), "balanced", "positive", "negative")


def q_class_prf(spark, sf):
    counts = mt.label_counts(views.predictions(spark, sf), [*LABELS, 10])
    return _round(mt.class_prf(counts), "precision", "recall", "f1")


def q_micro_macro_weighted(spark, sf):
    counts = mt.label_counts(views.predictions(spark, sf), LABELS)
    return _list(_round(mt.micro_macro_weighted(counts), *SCORES))


def hot_predictions(spark, sf):
    """Every class whose mean is at most 2 % farther than the nearest one is predicted."""
    rows = views.vectors(spark, sf)
    d = distances_to(list(class_means(rows).values()))
    near = rows.withColumn("d", d).withColumn("limit", F.array_min("d") * 1.02)
    hot = F.zip_with("d", F.array_repeat("limit", 10), lambda x, m: (x <= m).cast("int"))
    return near.select("row_id", one_hot("sentiment", LABELS).alias("hot_true"), hot.alias("hot_pred"))


def q_multi_hot_metrics(spark, sf):
    counts = mt.multi_hot_counts(hot_predictions(spark, sf), 10)
    return _list(_round(mt.micro_macro_weighted(counts, present_only=False), *SCORES))


def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(views.predictions(spark, sf), LABELS)


def q_classification_report(spark, sf):
    counts = mt.label_counts(views.predictions(spark, sf), [*LABELS, 10])
    return _round(mt.classification_report(counts, zero_division=1.0), "precision", "recall", "f1")


def q_evaluation_wide(spark, sf):
    counts = mt.label_counts(views.predictions(spark, sf), LABELS)
    return _round(mt.evaluation_wide(counts, "all vectors", 10), *SCORES)


def _planted():
    return F.col("row_id") % 25 == 0


def _cells(spark, sf):
    """Predictions of each language, all rows (N) and without the planted rows (Y), as two ladders of four."""
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    rows = views.predictions(spark, sf).join(docs, "row_id")
    position = F.expr("CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END")
    flags = F.when(_planted(), F.array(F.lit("N"))).otherwise(F.array(F.lit("N"), F.lit("Y")))
    rows = rows.withColumn("position", position).withColumn("denoised", F.explode(flags))
    return rows.withColumn("cell", F.concat("lang", F.lit("-"), "denoised"))


def ledger(spark, sf) -> DataFrame:
    rows = _cells(spark, sf)
    scores = mt.micro_macro_weighted(mt.label_counts(rows, LABELS, ["cell"]), ["cell"])
    shares = distribution_string(rows, "y_true", [0, 1, 2, 3], ["cell"])
    cells = rows.groupBy("cell", "position", "denoised").agg(
        F.sum((~_planted()).cast("bigint")).alias("origin"), F.sum(_planted().cast("bigint")).alias("noise")
    )
    cells = cells.join(shares.withColumnRenamed("distribution", "sentiments_distribution"), "cell")
    return lg.ledger_rows(scores, cells.withColumn("noise_sources_distribution", F.lit("-")), sizes=4)


def rounded_ledger(rows: DataFrame) -> DataFrame:
    return _list(_round(rows, *SCORES))


def q_ledger_append(spark, sf):
    rows = ledger(spark, sf)
    noisy = rows.filter(F.col("denoised") == "N")
    return rounded_ledger(lg.ledger_append(noisy, rows.filter(F.col("denoised") == "Y")))


def q_report_summary(spark, sf):
    rows = _cells(spark, sf)
    scores = mt.micro_macro_weighted(mt.label_counts(rows, LABELS, ["lang", "denoised"]), ["lang", "denoised"])
    sizes = rows.groupBy("lang", "denoised").agg(F.count(F.lit(1)).alias("train_size"))
    nested = scores.join(sizes, ["lang", "denoised"]).select(
        F.concat(F.lit("centroid-"), "lang").alias("name"),
        F.when(F.col("denoised") == "N", "train").otherwise("validate").alias("data_type"),
        "train_size",
        F.lit(0).cast("bigint").alias("test_size"),
        F.struct(
            F.col("micro_f1").alias("accuracy"),
            F.struct(F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"),
                     F.col("macro_f1").alias("f1")).alias("macro_avg"),
            F.struct(F.col("weighted_f1").alias("f1")).alias("weighted_avg"),
        ).alias("report"),
        F.struct(F.lit(0.0).alias("eval_loss"), F.lit(0.0).alias("preprocess"), F.lit(0.0).alias("train"),
                 F.lit(0.0).alias("predict")).alias("args"),
    )
    return _round(lg.report_summary(nested), "accuracy", "macro_f1", "macro_precision", "macro_recall", "weighted_f1")


def q_series(spark, sf):
    points = lg.series(ledger(spark, sf), "origin + noise", "macro_f1", lg.denoised_lines())
    return _round(points, "y")


def q_series_by_experiment_block(spark, sf):
    rows = views.predictions(spark, sf).withColumn("experiment", (F.col("row_id") % 27 + 1).cast("int"))
    scores = mt.micro_macro_weighted(mt.label_counts(rows, LABELS, ["experiment"]), ["experiment"])
    sizes = rows.groupBy("experiment").agg(F.count(F.lit(1)).alias("origin"))
    points = lg.series(scores.join(sizes, "experiment"), "origin", "macro_f1", lg.block_lines())
    return _round(points, "y")


def q_best_epoch(spark, sf):
    best = lg.replay_callbacks(views.history(spark, sf), patience=3)
    return best.withColumn("lr_cuts", F.array_join(F.col("lr_cuts").cast("array<string>"), ",")).withColumn(
        "final_lr", F.round("final_lr", 9)
    )


QUERIES = {
    "class_weights": q_class_weights,
    "class_prf": q_class_prf,
    "micro_macro_weighted": q_micro_macro_weighted,
    "multi_hot_metrics": q_multi_hot_metrics,
    "confusion_matrix": q_confusion_matrix,
    "classification_report": q_classification_report,
    "evaluation_wide": q_evaluation_wide,
    "ledger_append": q_ledger_append,
    "report_summary": q_report_summary,
    "series": q_series,
    "series_by_experiment_block": q_series_by_experiment_block,
    "best_epoch": q_best_epoch,
}


def _counts(source: str, labels: str, by: str = "") -> str:
    """counts(by, label, tp, support, predicted) with zero rows, then scores with 0/0 as 0."""
    b = f"{by}, " if by else ""
    keys = f"SELECT DISTINCT {by} FROM {source}" if by else "SELECT 1"
    on = " AND ".join(f"g.{c.strip()} = c.{c.strip()}" for c in by.split(",")) + " AND " if by else ""
    gb = "".join(f"g.{c.strip()}, " for c in by.split(",")) if by else ""
    return f"""
        sides AS (SELECT {b}y_true AS label, (y_true = y_pred)::INT AS tp, 1 AS support, 0 AS predicted FROM {source}
                  UNION ALL SELECT {b}y_pred, 0, 0, 1 FROM {source}),
        counts AS (SELECT {gb}g.label, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(support), 0)::BIGINT AS support,
                          coalesce(sum(predicted), 0)::BIGINT AS predicted
                   FROM (SELECT * FROM ({keys}) k, (SELECT unnest({labels}) AS label)) g
                   LEFT JOIN sides c ON {on}g.label = c.label GROUP BY ALL)"""


def _scored(zero: str = "0", source: str = "counts") -> str:
    return f"""
        scores AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE {zero} END::DOUBLE AS precision,
                          CASE WHEN support > 0 THEN tp / support ELSE {zero} END::DOUBLE AS recall,
                          CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE {zero} END::DOUBLE AS f1
                   FROM {source})"""


def _summary(by: str = "", present: str = "support + predicted > 0", rounded: bool = True) -> str:
    def r(expr: str, name: str) -> str:
        return f"round({expr}, 6) AS {name}" if rounded else f"{expr} AS {name}"

    b = f"{by}, " if by else ""
    return f"""SELECT {b}{r('2 * sum(tp) / (sum(support) + sum(predicted))', 'micro_f1')},
        {r(f'avg(f1) FILTER ({present})', 'macro_f1')},
        {r('sum(f1 * support) / sum(support)', 'weighted_f1')},
        {r(f'avg(precision) FILTER ({present})', 'macro_precision')},
        {r(f'avg(recall) FILTER ({present})', 'macro_recall')},
        string_agg(printf('%.3f', round(f1, 3)), ',' ORDER BY label) AS f1_of_classes
        FROM scores {'GROUP BY ' + by if by else ''}"""


_TEN = "range(0, 10)"
_ELEVEN = "range(0, 11)"
LEDGER_SQL = f"""
    cells AS (SELECT p.*, d.lang, f.denoised,
                     CASE d.lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS position
              FROM predictions p JOIN documents d ON p.row_id = d.doc_id
              JOIN (VALUES ('N'), ('Y')) f(denoised) ON f.denoised = 'N' OR p.row_id % 25 <> 0),
    {_counts('cells', _TEN, 'lang, denoised')}, {_scored()},
    summary AS ({_summary('lang, denoised')}),
    info AS (SELECT lang, denoised, any_value(position) AS position, count(*) AS train_size,
                    count(*) FILTER (row_id % 25 <> 0) AS origin, count(*) FILTER (row_id % 25 = 0) AS noise,
                    printf('[%.1f%%, %.1f%%, %.1f%%, %.1f%%]', avg((y_true = 0)::INT) * 100, avg((y_true = 1)::INT) * 100,
                           avg((y_true = 2)::INT) * 100, avg((y_true = 3)::INT) * 100) AS sentiments_distribution
             FROM cells GROUP BY 1, 2),
    ledger AS (SELECT (position + CASE WHEN denoised = 'Y' THEN 4 ELSE 0 END)::INT AS experiment, origin, noise,
                      denoised, s.* EXCLUDE (lang, denoised), sentiments_distribution,
                      '-' AS noise_sources_distribution
               FROM summary s JOIN info USING (lang, denoised))"""

ORACLE = {
    "class_weights": sql("vectors", """
        WITH c AS (SELECT sentiment, count(*) AS n FROM vectors GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k FROM c)
        SELECT sentiment, c.n, round(t.n / (t.k * c.n), 6) AS balanced, round(t.n / (2 * c.n), 6) AS positive,
               round(t.n / (2 * (t.n - c.n)), 6) AS negative FROM c, t"""),
    "class_prf": sql("predictions", f"""
        WITH {_counts('predictions', _ELEVEN)}, {_scored()}
        SELECT label::INT AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM scores"""),
    "micro_macro_weighted": sql("predictions", f"""
        WITH {_counts('predictions', _TEN)}, {_scored()} {_summary()}"""),
    "multi_hot_metrics": sql("vector_long", f"""
        WITH d AS (SELECT l.row_id, l.sentiment AS y, m.sentiment AS label, sqrt(sum((l.x - m.m) * (l.x - m.m))) AS d
            FROM vector_long l JOIN (SELECT sentiment, pos, avg(x) AS m FROM vector_long GROUP BY 1, 2) m ON l.pos = m.pos
            GROUP BY 1, 2, 3),
        hot AS (SELECT label, (y = label)::INT AS t, (d <= 1.02::DOUBLE * min(d) OVER (PARTITION BY row_id))::INT AS p FROM d),
        counts AS (SELECT label, sum(t * p)::BIGINT AS tp, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted
                   FROM hot GROUP BY label), {_scored()} {_summary(present='true')}"""),
    "confusion_matrix": sql("predictions", f"""
        SELECT label::INT AS y_true, {", ".join(f"count(*) FILTER (y_pred = {i}) AS c{i}" for i in range(10))}
        FROM (SELECT unnest({_TEN}) AS label) LEFT JOIN predictions ON y_true = label GROUP BY label"""),
    "classification_report": sql("predictions", f"""
        WITH {_counts('predictions', _ELEVEN)}, {_scored('1')},
        report AS (
            SELECT label::VARCHAR AS name, precision, recall, f1, support FROM scores
            UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
                             sum(support)::BIGINT FROM scores
            UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM scores
            UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                             sum(f1 * support) / sum(support), sum(support)::BIGINT FROM scores)
        SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""),
    "evaluation_wide": sql("predictions", f"""
        WITH {_counts('predictions', _TEN)}, {_scored()}, s AS ({_summary()})
        SELECT 'all vectors' AS data_size, s.* EXCLUDE (f1_of_classes),
               {", ".join(f"(SELECT round(f1, 3) FROM scores WHERE label = {i}) AS f1_of_class_{i}" for i in range(10))}
        FROM s"""),
    "ledger_append": sql("predictions", f"WITH {LEDGER_SQL} SELECT * FROM ledger"),
    "report_summary": sql("predictions", f"""
        WITH {LEDGER_SQL}
        SELECT 'centroid-' || lang AS name, CASE denoised WHEN 'N' THEN 'train' ELSE 'validate' END AS data_type,
               train_size, 0::BIGINT AS test_size, micro_f1 AS accuracy, 0.0::DOUBLE AS loss, macro_f1, macro_precision,
               macro_recall, weighted_f1, 0.0::DOUBLE AS time_preprocess, 0.0::DOUBLE AS time_train,
               0.0::DOUBLE AS time_predict
        FROM summary JOIN info USING (lang, denoised)"""),
    "series": sql("predictions", f"""
        WITH {LEDGER_SQL} SELECT CASE denoised WHEN 'N' THEN 'Noisy Data' ELSE 'Denoised Data' END AS line,
               origin + noise AS x, macro_f1 AS y FROM ledger"""),
    "series_by_experiment_block": sql("predictions", f"""
        WITH cells AS (SELECT *, (row_id % 27 + 1)::INT AS experiment FROM predictions),
        {_counts('cells', _TEN, 'experiment')}, {_scored()}, summary AS ({_summary('experiment')})
        SELECT CASE WHEN experiment <= 7 THEN 'Original Data' WHEN experiment <= 11 THEN 'Mislabeled Noise'
                    WHEN experiment <= 15 THEN 'Irrelevant Noise' WHEN experiment <= 19 THEN 'Translated Noise(0% mislabeled)'
                    WHEN experiment <= 23 THEN 'Translated Noise(50% mislabeled)'
                    ELSE 'Translated Noise(100% mislabeled)' END AS line,
               (SELECT count(*) FROM cells c WHERE c.experiment = s.experiment) AS x, macro_f1 AS y
        FROM summary s"""),
    "best_epoch": sql("history", """
        WITH h AS (SELECT run, epoch, val_accuracy AS acc, val_loss AS loss,
                          row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM history),
        fold AS (
            SELECT run, 1::BIGINT AS i, acc AS best, epoch AS best_epoch, 0 AS wait, NULL::INT AS stop, loss AS low,
                   0 AS lr_wait, 0.0001::DOUBLE AS lr, '' AS cuts FROM h WHERE i = 1
            UNION ALL
            SELECT run, i, best, best_epoch, wait, CASE WHEN wait >= 3 THEN epoch END, low,
                   CASE WHEN cut THEN 0 ELSE lr_wait END,
                   CASE WHEN cut THEN greatest(lr * 0.1::DOUBLE, 0.000001::DOUBLE) ELSE lr END,
                   CASE WHEN cut THEN cuts || CASE WHEN cuts = '' THEN '' ELSE ',' END || epoch ELSE cuts END
            FROM (SELECT h.run, h.i, h.epoch, f.lr, f.cuts,
                         CASE WHEN h.acc > f.best THEN h.acc ELSE f.best END AS best,
                         CASE WHEN h.acc > f.best THEN h.epoch ELSE f.best_epoch END AS best_epoch,
                         CASE WHEN h.acc > f.best THEN 0 ELSE f.wait + 1 END AS wait,
                         CASE WHEN h.loss < f.low - 0.0001::DOUBLE THEN h.loss ELSE f.low END AS low,
                         CASE WHEN h.loss < f.low - 0.0001::DOUBLE THEN 0 ELSE f.lr_wait + 1 END AS lr_wait,
                         f.lr > 0.000001::DOUBLE AND h.loss >= f.low - 0.0001::DOUBLE AS cut
                  FROM fold f JOIN h ON h.run = f.run AND h.i = f.i + 1 WHERE f.stop IS NULL))
        SELECT run, best_epoch, best AS best_val_accuracy, stop AS stop_epoch, cuts AS lr_cuts, round(lr, 9) AS final_lr
        FROM fold QUALIFY row_number() OVER (PARTITION BY run ORDER BY i DESC) = 1""").replace("WITH ", "WITH RECURSIVE ", 1),
}
