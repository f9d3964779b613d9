"""Scores of a classifier from (label, prediction, score) rows: confusion, macro scores, AUC, ROC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.prefix import ordered_totals, value_ranges

ROC_POINTS = 50


def confusion(df: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """``(label, prediction, n)``; with ``weight``, a column of whole numbers, each row counts that often."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n")
    )


def macro_scores(table: DataFrame) -> DataFrame:
    """One row: accuracy and unweighted means of F1, precision and recall; an empty class scores 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("true_n"), zero.alias("pred_n"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), zero.alias("true_n"), F.col("n").alias("pred_n"), zero.alias("hits")),
    )
    classes = table.select(F.inline(roles)).groupBy("class").agg(
        F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"), F.sum("hits").alias("hits")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    hits, true_n, pred_n = F.col("hits"), F.col("true_n"), F.col("pred_n")
    return classes.agg(
        F.round(F.sum(hits) / F.sum(true_n), 4).alias("accuracy"),
        F.round(F.avg(ratio(hits * 2.0, true_n + pred_n)), 4).alias("f1_score"),
        F.round(F.avg(ratio(hits, pred_n)), 4).alias("precision"),
        F.round(F.avg(ratio(hits, true_n)), 4).alias("recall"),
    )


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """One row ``(n, majority_share, classes)``: what always guessing the most common label scores."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("n"), F.round(F.max("n") / F.sum("n"), 4).alias("majority_share"),
        F.count(F.lit(1)).alias("classes"),
    )


def score_totals(df: DataFrame, positive, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Distinct scores with positives, negatives and their running totals, rows counted ``weight`` times."""
    by = by or []
    times = (F.col(weight) if weight else F.lit(1)).cast("long").alias("times")
    rows = df.select(*by, positive.cast("boolean").alias("positive"), F.col(score).cast("double").alias("score"), times)
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("times"))), F.lit(0).cast("long"))
    counts = rows.groupBy(*by, F.col("score").alias("value")).agg(
        of(F.col("positive")).alias("n_pos"), of(~F.col("positive")).alias("n_neg"),
    ).select(*by, F.lit("score").alias("column"), "value", "n_pos", "n_neg", F.lit(1).alias("one"))
    return ordered_totals(counts, value_ranges(rows, ["score"]), ["n_pos", "n_neg", "one"], by)


def auc_from_totals(totals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., auc)``: the share of (positive, negative) pairs in the right order, ties one half; exact."""
    by = by or []
    won = F.col("n_pos") * (F.col("n_neg_before") + F.col("n_neg") / 2.0)
    pairs = F.max("n_pos_total").cast("double") * F.max("n_neg_total")
    return totals.groupBy(*by).agg(F.try_divide(F.sum(won), pairs).alias("auc"))


def auc(df: DataFrame, positive, score: str, by: list[str] | None = None) -> DataFrame:
    return auc_from_totals(score_totals(df, positive, score, by), by)


def roc_points(totals: DataFrame, points: int = ROC_POINTS) -> DataFrame:
    """``(position, fpr, tpr)``: the curve from the highest score down, thinned to about ``points`` rows.

    Position 0 is the origin; every max(1, n // points)-th position is kept, as published.
    """
    position = F.col("one_total") - F.col("one_before")
    step = F.greatest(F.lit(1), F.expr(f"(one_total + 1) div {int(points)}"))
    rate = lambda m: F.round(F.try_divide(
        (F.col(f"{m}_total") - F.col(f"{m}_before")).cast("double"), F.col(f"{m}_total")), 4)
    curve = totals.where(F.pmod(position, step) == 0).select(
        position.cast("long").alias("position"), rate("n_neg").alias("fpr"), rate("n_pos").alias("tpr")
    )
    origin = totals.limit(1).select(
        F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(curve)
