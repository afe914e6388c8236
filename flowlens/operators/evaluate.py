"""Labels against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ground_truth, round_places
from ..schemas import LABELS
from ..session import literal_rows
from .ordering import running_totals


def evaluated(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Rows whose truth is one of the three labels after alias resolution."""
    named = rows.withColumn(truth, ground_truth(F.col(truth)))
    return named.where(F.col(truth).isNotNull() & F.col(predicted).isin(*LABELS))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Rows per (truth, predicted), all nine cells."""
    cells = [(t, p, 0) for t in LABELS for p in LABELS]
    frame = literal_rows(rows.sparkSession, ["truth", "predicted", "n"], cells)
    counted = evaluated(rows, truth, predicted).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(frame).groupBy("truth", "predicted").agg(F.sum("n").alias("n"))


def eval_metrics(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy, and precision, recall and F1 of Malicious against the rest (from rounded values)."""
    t, p = F.col(truth), F.col(predicted)
    bad = F.lit("Malicious")
    sums = evaluated(rows, truth, predicted).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(t == p).alias("right"),
        F.count_if((t == bad) & (p == bad)).alias("tp"),
        F.count_if((t != bad) & (p == bad)).alias("fp"),
        F.count_if((t == bad) & (p != bad)).alias("fn"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, round_places(part / whole, 4)).otherwise(0.0)

    rates = sums.select(
        F.col("total").alias("total_evaluated"),
        ratio(F.col("right"), F.col("total")).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
    pr, re = F.col("precision"), F.col("recall")
    return rates.withColumn("f1_score", ratio(2 * pr * re, pr + re))


def model_metrics(rows: DataFrame, correct: Column) -> DataFrame:
    """Samples and accuracy, 1.0 if there are none."""
    sums = rows.agg(F.count(F.lit(1)).alias("samples_processed"), F.count_if(correct).alias("right"))
    rate = F.when(F.col("samples_processed") > 0, F.col("right") / F.col("samples_processed")).otherwise(1.0)
    return sums.select("samples_processed", round_places(rate, 4).alias("rolling_accuracy"))


def running_accuracy(rows: DataFrame, key: str, order: list[str], correct: Column) -> DataFrame:
    """Accuracy of each stream up to and including each row."""
    totals = running_totals(rows, [key], order, {"samples": F.lit(1), "right": F.coalesce(correct, F.lit(False)).cast("long")})
    return totals.withColumn("accuracy", F.col("right") / F.col("samples"))
