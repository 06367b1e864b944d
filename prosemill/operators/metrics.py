"""Evaluation: confusion, precision and recall, ROC-AUC, folds, sources, worst errors.

Every report is one aggregation over (label, predicted, probability) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def with_prediction(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def _cell(label: int, predicted: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("predicted") == predicted))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.agg(_cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp"))


def class_report(rows: DataFrame) -> DataFrame:
    """precision, recall, f1 and support for each class, with macro and weighted averages; 0 for 0 / 0."""
    n = confusion(rows)

    def scores(name: str, hit: str, wrong: str, missed: str) -> Column:
        p, r = ratio(F.col(hit).cast("double"), F.col(hit) + F.col(wrong)), ratio(F.col(hit).cast("double"), F.col(hit) + F.col(missed))
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (F.col(hit) + F.col(missed)).alias("support"))

    both = n.select(scores("0", "tn", "fn", "fp").alias("a"), scores("1", "tp", "fp", "fn").alias("b"))
    total = F.col("a.support") + F.col("b.support")
    macro = [((F.col(f"a.{m}") + F.col(f"b.{m}")) / 2).alias(m) for m in ("precision", "recall", "f1")]
    weighted = [ratio(F.col(f"a.{m}") * F.col("a.support") + F.col(f"b.{m}") * F.col("b.support"), total).alias(m) for m in ("precision", "recall", "f1")]
    return both.select(F.inline(F.array("a", "b", F.struct(F.lit("macro avg").alias("class"), *macro, total.alias("support")), F.struct(F.lit("weighted avg").alias("class"), *weighted, total.alias("support")))))


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


def fold_accuracy(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' accuracies."""
    folds = rows.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a"))
    return folds.agg(F.count("*").alias("n_folds"), F.avg("a").alias("mean_accuracy"), F.stddev_pop("a").alias("std_accuracy"))


def accuracy_by_source(rows: DataFrame) -> DataFrame:
    """n, correct, accuracy and the labels that occur, per source."""
    hit = (F.col("label") == F.col("predicted")).cast("long")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(hit).alias("correct"), F.avg(hit.cast("double")).alias("accuracy"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"))


def roc_auc(rows: DataFrame, ranges: int = 4096) -> DataFrame:
    """Area under the curve from average ranks; null with a single class.

    Rows are summed by probability first, so what is ranked is distinct
    probabilities, and ties need no special case.  These are ranked in ``ranges``
    of probability, to which the counts of the ranges below are added.  The sums are
    stored, as they are read twice and what makes ``rows`` may be long.
    """
    from ..sources.tables import stored

    by = rows.groupBy("probability").agg(F.count_if(F.col("label") == 1).cast("double").alias("pos"), F.count_if(F.col("label") == 0).cast("double").alias("neg")).withColumn("range", F.floor(F.col("probability") * ranges))
    by = stored(by)
    sums = by.groupBy("range").agg(F.sum("neg").alias("n"))
    under = sums.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("under"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    met = by.withColumn("below", below).join(under, "range")
    area = met.withColumn("won", F.col("pos") * (F.col("under") + F.col("below") + F.col("neg") / 2)).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return area.select((F.col("won") / F.when(F.col("p") * F.col("n") > 0, F.col("p") * F.col("n"))).alias("roc_auc"))


def binned_roc_auc(rows: DataFrame, bins: int = 100_000) -> DataFrame:
    """As ``roc_auc`` with probabilities rounded to ``1 / bins``: what is ranked is bounded for any number of rows."""
    return roc_auc(rows.withColumn("probability", F.round(F.col("probability") * bins) / bins))


def source_gap(rows: DataFrame, base: str, other: str) -> DataFrame:
    """Accuracy of sources that start with ``base`` less that of sources that hold ``other``, and what it says."""
    hit = (F.col("label") == F.col("predicted")).cast("double")
    both = rows.agg(F.avg(F.when(F.col("source").startswith(base), hit)).alias("base_accuracy"), F.avg(F.when(F.col("source").contains(other), hit)).alias("other_accuracy"))
    gap = F.col("base_accuracy") - F.col("other_accuracy")
    return both.withColumn("gap", gap).withColumn("finding", F.when(gap.isNull(), "not computable").when(gap > 0, "harder").otherwise("not harder"))


def worst_errors(rows: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The most confident wrong rows."""
    return rows.filter(F.col("label") != F.col("predicted")).withColumn("certainty", F.abs(F.col("probability") - 0.5)).orderBy(F.desc("certainty"), key).limit(k)
