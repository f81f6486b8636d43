"""Outlier and label-error detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelab.operators import confident as cl, neighbors as nb
from sievelab.operators.cleaning import collect_labels
from sievelab.operators.summaries import detector_quality, outlier_counts
from sievelab.plans import views
from sievelab.plans.oracle import sql
from sievelab.session import cut_lineage

K = 5


def q_knn_selfjoin(spark, sf):
    edges = nb.knn_selfjoin(views.vectors(spark, sf), K, "sentiment")
    return edges.withColumn("distance", F.round("distance", 6))


def q_lof_score(spark, sf):
    return nb.lof_score(views.outlier_vectors(spark, sf), K, "sentiment").withColumn("lof", F.round("lof", 6))


def q_lof_flag_by_class(spark, sf):
    return nb.lof_flag(views.outlier_vectors(spark, sf), K, "sentiment").select("row_id", "markasnoise")


def q_lof_flag_global(spark, sf):
    return nb.lof_flag(views.outlier_vectors(spark, sf), K).select("row_id", "markasnoise")


def q_attach_flags(spark, sf):
    rows = views.outlier_vectors(spark, sf)
    return nb.attach_flags(rows.select("row_id", "sentiment", "noise"), nb.lof_flag(rows, K, "sentiment"))


def q_lof_clean(spark, sf):
    rows = views.outlier_vectors(spark, sf)
    return nb.keep_clean(rows, nb.lof_flag(rows, K, "sentiment")).select("row_id", "sentiment")


def q_merge_class_parts(spark, sf):
    rows = views.outlier_vectors(spark, sf)
    flagged = cut_lineage(nb.attach_flags(rows.select("row_id", "sentiment"), nb.lof_flag(rows, K, "sentiment")))
    return nb.merge_class_parts([flagged.filter(F.col("sentiment") == y) for y in collect_labels(rows, "sentiment")])


def q_detector_quality(spark, sf):
    rows = views.outlier_vectors(spark, sf)
    quality = detector_quality(nb.attach_flags(rows, nb.lof_flag(rows, K, "sentiment")))
    return quality.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def q_outlier_counts(spark, sf):
    rows = views.outlier_vectors(spark, sf)
    counts = outlier_counts(nb.attach_flags(rows, nb.lof_flag(rows, K, "sentiment")), ["sentiment"])
    return counts.withColumn("share", F.round("share", 6))


def q_oof_probabilities(spark, sf):
    rows = cl.centroid_oof_probabilities(views.noisy_vectors(spark, sf))
    long = rows.select("row_id", "fold", F.posexplode_outer("probs").alias("class", "prob"))
    return long.withColumn("prob", F.round("prob", 6))


def q_confident_joint(spark, sf):
    return cl.confident_joint(views.probabilities(spark, sf)).withColumn("calibrated", F.round("calibrated", 6))


def q_find_label_errors(spark, sf):
    rows = views.probabilities(spark, sf)
    errors = cl.find_label_errors(rows, cl.confident_joint(rows))
    return errors.withColumn("margin", F.round("margin", 6))


def q_noise_rate_matrix(spark, sf):
    rates = cl.noise_rate_matrix(cl.confident_joint(views.probabilities(spark, sf)))
    for c in ("p_true_given", "p_given_true", "class_weight"):
        rates = rates.withColumn(c, F.round(c, 6))
    return rates


QUERIES = {
    "knn_selfjoin": q_knn_selfjoin,
    "lof_score": q_lof_score,
    "lof_flag_by_class": q_lof_flag_by_class,
    "lof_flag_global": q_lof_flag_global,
    "attach_flags": q_attach_flags,
    "lof_clean": q_lof_clean,
    "merge_class_parts": q_merge_class_parts,
    "detector_quality": q_detector_quality,
    "outlier_counts": q_outlier_counts,
    "oof_probabilities": q_oof_probabilities,
    "confident_joint": q_confident_joint,
    "find_label_errors": q_find_label_errors,
    "noise_rate_matrix": q_noise_rate_matrix,
}


def _lof(group: str, source: str = "outlier_vectors") -> str:
    """edges and lof over the five nearest rows with the same value of ``group``."""
    return f"""
        edges AS (SELECT a.row_id, b.row_id AS neighbor_id, list_distance(a.features, b.features) AS distance
                  FROM {source} a JOIN {source} b ON {group} AND a.row_id <> b.row_id
                  QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY distance, b.row_id) <= 5),
        kd AS (SELECT row_id, max(distance) AS kd FROM edges GROUP BY 1),
        density AS (SELECT e.row_id, 1 / (avg(greatest(kd, distance)) + 1e-10::DOUBLE) AS density
                    FROM edges e JOIN kd ON e.neighbor_id = kd.row_id GROUP BY 1),
        lof AS (SELECT e.row_id, avg(o.density) / any_value(p.density) AS lof
                FROM edges e JOIN density o ON e.neighbor_id = o.row_id JOIN density p ON e.row_id = p.row_id GROUP BY 1),
        flags AS (SELECT v.row_id, v.sentiment, v.noise, coalesce(lof > 1.5::DOUBLE, false)::INT AS markasnoise
                  FROM outlier_vectors v LEFT JOIN lof USING (row_id))"""


_CLASS = "a.sentiment = b.sentiment"
_JOINT = """
    thresholds AS (SELECT sentiment AS class, avg(prob) AS t, count(*) AS total FROM probabilities
                   WHERE class = sentiment GROUP BY 1),
    sure AS (SELECT row_id, sentiment AS given, arg_max(p.class, prob) AS true_class
             FROM probabilities p JOIN thresholds t ON p.class = t.class WHERE prob >= t GROUP BY 1, 2),
    grid AS (SELECT g.class AS given, t.class AS true_class, g.total FROM thresholds g, thresholds t),
    counted AS (SELECT g.given, g.true_class, g.total,
                       CASE WHEN g.given = g.true_class THEN greatest(1, count(s.row_id)) ELSE count(s.row_id) END AS n,
                       count(s.row_id) AS raw
                FROM grid g LEFT JOIN sure s ON g.given = s.given AND g.true_class = s.true_class GROUP BY 1, 2, 3),
    joint AS (SELECT given, true_class, n, n / sum(n) OVER (PARTITION BY given) * total AS calibrated FROM counted)"""

ORACLE = {
    "knn_selfjoin": sql("vectors", """
        SELECT a.row_id, b.row_id AS neighbor_id, round(list_distance(a.features, b.features), 6) AS distance,
               row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features), b.row_id)::INT
                   AS rank
        FROM vectors a JOIN vectors b ON a.sentiment = b.sentiment AND a.row_id <> b.row_id QUALIFY rank <= 5"""),
    "lof_score": sql("outlier_vectors", f"WITH {_lof(_CLASS)} SELECT row_id, round(lof, 6) AS lof FROM lof"),
    "lof_flag_by_class": sql("outlier_vectors", f"WITH {_lof(_CLASS)} SELECT row_id, markasnoise FROM flags"),
    "lof_flag_global": sql("outlier_vectors", f"WITH {_lof('true')} SELECT row_id, markasnoise FROM flags"),
    "attach_flags": sql("outlier_vectors", f"WITH {_lof(_CLASS)} SELECT row_id, sentiment, noise, markasnoise FROM flags"),
    "merge_class_parts": sql("outlier_vectors", f"WITH {_lof(_CLASS)} SELECT row_id, sentiment, markasnoise FROM flags"),
    "lof_clean": sql("outlier_vectors", f"WITH {_lof(_CLASS)} SELECT row_id, sentiment FROM flags WHERE markasnoise = 0"),
    "detector_quality": sql("outlier_vectors", f"""
        WITH {_lof(_CLASS)}, c AS (SELECT count(*) FILTER (noise = 1 AND markasnoise = 1) AS tp,
               count(*) FILTER (noise = 0 AND markasnoise = 1) AS fp, count(*) FILTER (noise = 1 AND markasnoise = 0) AS fn,
               count(*) FILTER (noise = 0 AND markasnoise = 0) AS tn FROM flags)
        SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM c"""),
    "outlier_counts": sql("outlier_vectors", f"""
        WITH {_lof(_CLASS)} SELECT sentiment, count(*) AS n, sum(markasnoise)::BIGINT AS flagged,
               round(avg(markasnoise), 6) AS share FROM flags GROUP BY 1"""),
    "oof_probabilities": sql("noisy_long", """
        WITH folded AS (SELECT *, (('0x' || substr(md5('522:fold:' || row_id), 1, 8))::BIGINT % 5)::INT AS fold
                        FROM noisy_long),
        sums AS (SELECT fold, sentiment, pos, sum(x) AS s, count(*) AS n FROM folded GROUP BY 1, 2, 3),
        means AS (SELECT f.fold, s.sentiment AS class, s.pos, sum(s.s) / sum(s.n) AS m
                  FROM (SELECT unnest(range(0, 5)) AS fold) f JOIN sums s ON s.fold <> f.fold GROUP BY 1, 2, 3),
        w AS (SELECT row_id, fold, class, exp(-8 * sqrt(sum((x - m) * (x - m)))) AS w
              FROM folded JOIN means USING (fold, pos) GROUP BY 1, 2, 3)
        SELECT row_id, fold, class, round(w / sum(w) OVER (PARTITION BY row_id), 6) AS prob FROM w"""),
    "confident_joint": sql("probabilities", f"""
        WITH {_JOINT} SELECT given, true_class AS true, n, round(calibrated, 6) AS calibrated FROM joint"""),
    "find_label_errors": sql("probabilities", f"""
        WITH {_JOINT}, margins AS (
            SELECT a.row_id, a.sentiment AS given, a.class AS true, a.prob - b.prob AS margin
            FROM probabilities a JOIN probabilities b ON a.row_id = b.row_id AND b.class = b.sentiment
            WHERE a.class <> a.sentiment),
        ranked AS (SELECT m.*, round_even(calibrated, 0) AS quota,
                          row_number() OVER (PARTITION BY m.given, m.true ORDER BY margin DESC, row_id) AS pos
                   FROM margins m JOIN joint j ON m.given = j.given AND m.true = j.true_class)
        SELECT row_id, given, "true", round(margin, 6) AS margin FROM ranked WHERE pos <= quota"""),
    "noise_rate_matrix": sql("probabilities", f"""
        WITH {_JOINT}, rates AS (SELECT given, true_class AS true, calibrated / sum(calibrated) OVER (PARTITION BY given) AS tg,
               calibrated / sum(calibrated) OVER (PARTITION BY true_class) AS gt FROM joint)
        SELECT given, "true", round(tg, 6) AS p_true_given, round(gt, 6) AS p_given_true,
               round(CASE WHEN given = "true" THEN 1 / gt END, 6) AS class_weight FROM rates"""),
}
for _key in ("confident_joint", "find_label_errors", "noise_rate_matrix"):
    ORACLE[_key] = ORACLE[_key].replace(" AS true,", ' AS "true",').replace("m.true", 'm."true"')
