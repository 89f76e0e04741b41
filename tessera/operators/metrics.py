"""Classification metrics as grouped aggregates.

Everything is counted in integers and divided once at the end, so results do
not depend on partitioning. Zero denominators: recall, precision and F1 give
0.0; specificity and NPV give NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column, zero=None) -> Column:
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if zero is None else F.coalesce(r, F.lit(float(zero)))


def confusion_matrix(df: DataFrame, keys: Sequence[str], labels: Sequence[int] = (0, 1),
                     y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """G1: one row per (keys, true, predicted) cell of the label domain, empty
    cells included with count 0. The domain is exploded per group (no join
    with a constant table); counts are a partial aggregate."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(y_true).alias("true_label"),
                        F.col(y_pred).cast("int").alias("pred_label")).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("pred_label"))
                      for t in labels for p in labels])
    domain = df.select(*keys).distinct().select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")
    return (domain.join(counts, keys + ["true_label", "pred_label"], "left")
                  .select(*keys, "true_label", "pred_label",
                          F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def binary_counts(df: DataFrame, keys: Sequence[str], y_true: str = "y_true",
                  y_pred: str = "y_pred") -> DataFrame:
    # guard: a third class would leave the 2 x 2 matrix unnoticed
    two = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(
        F.raise_error(F.lit("the confusion matrix must be 2 x 2")).cast("int"))
    t, p = two(y_true), two(y_pred)
    return df.groupBy(*keys).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 1) & (p == 0)).alias("fn"))


def binary_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "y_true",
                   y_pred: str = "y_pred") -> DataFrame:
    """Accuracy, recall, specificity, precision, NPV, F1 per group."""
    c = binary_counts(df, keys, y_true, y_pred)
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    return c.select(*keys, "tp", "fp", "tn", "fn",
                    _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    _ratio(tp, tp + fn, 0).alias("recall"),
                    _ratio(tn, tn + fp).alias("specificity"),
                    _ratio(tp, tp + fp, 0).alias("precision"),
                    _ratio(tn, tn + fn).alias("npv"),
                    _ratio(tp * 2, tp * 2 + fp + fn, 0).alias("f1"))


def weighted_metrics(df: DataFrame, keys: Sequence[str], y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Support-weighted multi-class accuracy, recall, precision, F1
    (specificity and NPV are NULL)."""
    keys = list(keys)
    per_true = df.groupBy(*keys, F.col(y_true).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col(y_true) == F.col(y_pred)).alias("tp"))
    per_pred = df.groupBy(*keys, F.col(y_pred).cast("int").alias("cls")).agg(
        F.count(F.lit(1)).alias("predicted"))
    j = per_true.join(per_pred, keys + ["cls"], "left").fillna(0, ["predicted"])
    s, tp, pr = F.col("support"), F.col("tp"), F.col("predicted")
    return j.groupBy(*keys).agg(
        _ratio(F.sum(tp), F.sum(s)).alias("accuracy"),
        _ratio(F.sum(tp), F.sum(s)).alias("recall"),
        F.lit(None).cast("double").alias("specificity"),
        _ratio(F.sum(s * F.coalesce(_ratio(tp, pr), F.lit(0.0))), F.sum(s)).alias("precision"),
        F.lit(None).cast("double").alias("npv"),
        _ratio(F.sum(s * _ratio(tp * 2, s + pr, 0)), F.sum(s)).alias("f1"))


METRICS = ("accuracy", "recall", "specificity", "precision", "npv", "f1", "auc", "aupr")


def summarize(per_realization: DataFrame, keys: Sequence[str] = ("embedding",),
              metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean and population std of each metric over realizations."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_realization.groupBy(*keys).agg(*aggs)


def report_lines(summary: DataFrame, keys: Sequence[str] = ("embedding",),
                 metrics: Sequence[str] = METRICS) -> DataFrame:
    """``mean ± std`` to two decimals, one row per (keys, metric). Values
    are first rounded to 9 decimals so float summation order cannot move a
    value across a rounding boundary."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"),
                              F.concat(F.format_number(F.round(f"{m}_mean", 9), 2), F.lit(" ± "),
                                       F.format_number(F.round(f"{m}_std", 9), 2)).alias("text"))
                     for m in metrics])
    return summary.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
