"""Detection quality from true and predicted labels (1 = attack)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: attack share assumed for real traffic.
ASSUMED_PREVALENCE = 0.196

METRIC_COLUMNS = [
    "precision", "recall", "f1", "fpr", "adjusted_precision", "tp", "tn", "fp", "fn",
]


def evaluation_set(benign: DataFrame, attack: DataFrame, label: str = "is_attack") -> DataFrame:
    """Held-out benign rows (0) and all attacks (1) in one frame."""
    return benign.withColumn(label, F.lit(0)).unionByName(
        attack.withColumn(label, F.lit(1)), allowMissingColumns=True
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def confusion_counts(
    df: DataFrame, label: str = "is_attack", prediction: str = "prediction"
) -> DataFrame:
    true, flagged = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(
        F.count_if(true & flagged).alias("tp"),
        F.count_if(~true & ~flagged).alias("tn"),
        F.count_if(~true & flagged).alias("fp"),
        F.count_if(true & ~flagged).alias("fn"),
    )


def metrics_of(counts: DataFrame, prevalence: float = ASSUMED_PREVALENCE) -> DataFrame:
    """All ratios from the four counts; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = F.col("precision"), F.col("recall")
    p = F.lit(prevalence)
    return (
        counts.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("fpr", _ratio(fp, fp + tn))
        .withColumn("f1", _ratio(2 * precision * recall, precision + recall))
        .withColumn(
            "adjusted_precision",
            _ratio(p * recall, p * recall + (F.lit(1.0) - p) * F.col("fpr")),
        )
        .select(*METRIC_COLUMNS)
    )


def evaluate(
    df: DataFrame,
    label: str = "is_attack",
    prediction: str = "prediction",
    prevalence: float = ASSUMED_PREVALENCE,
) -> DataFrame:
    """One row of counts and metrics, from a single aggregate."""
    return metrics_of(confusion_counts(df, label, prediction), prevalence)


def recall_by_type(
    attacks: DataFrame, type_column: str = "event_type", prediction: str = "prediction"
) -> DataFrame:
    """Rows and recall of every attack type."""
    return attacks.groupBy(type_column).agg(
        F.count("*").alias("rows"), F.avg(F.col(prediction).cast("double")).alias("recall")
    )


def self_flag_rate(df: DataFrame, prediction: str = "is_outlier") -> DataFrame:
    """Share of rows flagged, for the check against the contamination."""
    return df.agg(F.avg(F.col(prediction).cast("double")).alias("self_flag_rate"))
