"""Classification scores. Rows are reduced to label counts by one aggregate; all else works on k rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(top: Column, bottom: Column, zero: float) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(float(zero)))


def _scores(counts: DataFrame, by: Sequence[str], zero: float) -> DataFrame:
    """(by, label, tp, support, predicted) to precision, recall and F1."""
    return counts.select(
        *by,
        "label",
        _ratio(F.col("tp"), F.col("predicted"), zero).alias("precision"),
        _ratio(F.col("tp"), F.col("support"), zero).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), zero).alias("f1"),
        "support",
        "tp",
        "predicted",
    )


def _with_all_labels(counts: DataFrame, labels: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Zero rows for labels that do not occur; ``labels`` is a short fixed list."""
    zeros = F.array(*[F.struct(F.lit(v).cast("int").alias("label")) for v in labels])
    keys = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    grid = keys.select(*by, F.inline(zeros))
    joined = grid.join(counts, [*by, "label"], "left")
    return joined.select(
        *by, "label", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "support", "predicted")]
    )


def label_counts(
    pred: DataFrame, labels: Sequence[int], by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """(by, label, tp, support, predicted) for single-label predictions."""
    cells = pred.groupBy(*by, y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    same = F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col(y_true).alias("label"), same.alias("tp"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(y_pred).alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
    )
    summed = cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )
    return _with_all_labels(summed, labels, by)


def multi_hot_counts(
    pred: DataFrame, k: int, by: Sequence[str] = (), y_true: str = "hot_true", y_pred: str = "hot_pred"
) -> DataFrame:
    """(by, label, tp, support, predicted) for 0/1 arrays; a row may hold none or several labels."""
    pairs = pred.select(*by, F.posexplode(F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))).alias("label", "c"))
    summed = pairs.groupBy(*by, "label").agg(
        F.sum(F.col("c.t") * F.col("c.p")).alias("tp"),
        F.sum("c.t").alias("support"),
        F.sum("c.p").alias("predicted"),
    )
    return _with_all_labels(summed, list(range(k)), by)


def class_prf(counts: DataFrame, by: Sequence[str] = (), zero_division: float = 0.0) -> DataFrame:
    """Precision, recall, F1 and support per class; 0/0 gives ``zero_division``."""
    return _scores(counts, by, zero_division).drop("tp", "predicted")


def micro_macro_weighted(
    counts: DataFrame, by: Sequence[str] = (), zero_division: float = 0.0, present_only: bool = True
) -> DataFrame:
    """One row per ``by``: micro, macro and weighted F1, macro precision and recall, F1 of each class.

    Macro means run over the labels that occur on either side, or over all with ``present_only=False``.
    The per-class F1 list always has every label and counts 0/0 as 0.
    """
    scores = _scores(counts, by, zero_division)
    present = (F.col("support") + F.col("predicted") > 0) | F.lit(not present_only)

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(present, F.col(c))), F.lit(0.0))

    f1_zero = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 0.0)
    listed = F.array_sort(F.collect_list(F.struct("label", F.round(f1_zero, 3).alias("f"))))
    aggs = [
        _ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted"), zero_division).alias("micro_f1"),
        mean("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"), zero_division).alias("weighted_f1"),
        mean("precision").alias("macro_precision"),
        mean("recall").alias("macro_recall"),
        F.transform(listed, lambda s: s["f"]).alias("f1_of_classes"),
    ]
    return scores.groupBy(*by).agg(*aggs)


def confusion_matrix(
    pred: DataFrame, labels: Sequence[int], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """One row per true label, one count column ``c<label>`` per predicted label, zeros kept."""
    columns = [F.coalesce(F.sum((F.col(y_pred) == v).cast("bigint")), F.lit(0)).alias(f"c{v}") for v in labels]
    counted = pred.groupBy(y_true).agg(*columns)
    dim = pred.sparkSession.createDataFrame([(int(v),) for v in labels], f"{y_true} int")
    filled = F.broadcast(dim).join(counted, y_true, "left")
    return filled.na.fill(0)


def classification_report(
    counts: DataFrame, names: Sequence[str] | None = None, zero_division: float = 0.0
) -> DataFrame:
    """Per-class rows, then ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = _scores(counts, [], zero_division)
    label = F.col("label").cast("string")
    if names is not None:
        label = F.get(F.lit(list(names)), F.col("label"))
    rows = scores.select(label.alias("name"), "precision", "recall", "f1", "support")
    weight = F.col("support") / F.sum("support").over(_whole())
    weighted = scores.withColumn("w", weight)
    totals = weighted.agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[F.sum(F.col(c) * F.col("w")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    summary = totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("name"), F.col("acc").alias("precision"),
                         F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support")),
                F.struct(F.lit("macro avg").alias("name"), F.col("m_precision").alias("precision"),
                         F.col("m_recall").alias("recall"), F.col("m_f1").alias("f1"), F.col("n").alias("support")),
                F.struct(F.lit("weighted avg").alias("name"), F.col("w_precision").alias("precision"),
                         F.col("w_recall").alias("recall"), F.col("w_f1").alias("f1"), F.col("n").alias("support")),
            )
        )
    )
    return rows.unionByName(summary)


def _whole():
    """Window over the k per-class rows of one report."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def evaluation_wide(counts: DataFrame, title: str, k: int, zero_division: float = 0.0) -> DataFrame:
    """One row with a title and one F1 column per class."""
    wide = micro_macro_weighted(counts, zero_division=zero_division)
    per_class = [F.get("f1_of_classes", F.lit(i)).alias(f"f1_of_class_{i}") for i in range(k)]
    return wide.select(F.lit(title).alias("data_size"), "micro_f1", "macro_f1", "weighted_f1", "macro_precision",
                       "macro_recall", *per_class)
