"""Alert threshold under a false-positive budget, and the full ROC curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.ordering import running_sums
from logvane.operators.quantiles import RANKED_ROWS, order_statistics

# Fixed value: highest accepted share of benign rows flagged.
FPR_BUDGET = 0.05


def allowed_false_positives(benign_rows: int, budget: float) -> int:
    """Largest count whose share of the benign rows is within the budget."""
    allowed = min(math.floor(budget * benign_rows), benign_rows)
    while allowed < benign_rows and (allowed + 1) / benign_rows <= budget:
        allowed += 1
    while allowed > 0 and allowed / benign_rows > budget:
        allowed -= 1
    return allowed


def tune_threshold(
    scores: DataFrame,
    label: str = "is_attack",
    score: str = "anomaly_score",
    budget: float = FPR_BUDGET,
    ranked_rows: int = RANKED_ROWS,
) -> float:
    """Highest threshold with the best recall among those within the budget.

    With K benign rows allowed above the threshold, it must exceed the
    (K+1)-th largest benign score; the lowest attack score that does catches
    every attack that can be caught. Two aggregates, no global sort.

    ``scores`` is read several times: pass a materialized frame.
    """
    benign = scores.where(F.col(label) == 0).select(F.col(score).alias("score"))
    rows = benign.agg(F.count("score")).first()[0]
    allowed = allowed_false_positives(rows, budget) if rows else 0
    barrier = -math.inf
    if allowed < rows:
        rank = rows - allowed - 1
        barrier = order_statistics(
            benign, {"score": [rank]}, {"score": rows}, ranked_rows
        )["score", rank]
    best = scores.where((F.col(label) == 1) & (F.col(score) > F.lit(barrier))).agg(
        F.min(score)
    ).first()[0]
    if best is None:
        raise ValueError(
            f"no attack scores above the benign scores allowed by a budget of {budget:.2%}"
        )
    return best


def roc_curve(
    scores: DataFrame, label: str = "is_attack", score: str = "anomaly_score"
) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score, highest first."""
    counts = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("_positives"),
        F.count_if(F.col(label) == 0).alias("_negatives"),
    )
    curve = running_sums(
        counts.withColumn("_rank", -F.col("threshold")),
        [F.col("_rank")],
        {"tp": F.col("_positives"), "fp": F.col("_negatives")},
    )
    totals = scores.agg(
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(F.col(label) == 0).alias("negatives"),
    ).first()

    def share(count: str, total: int) -> Column:
        return F.coalesce(F.try_divide(F.col(count), F.lit(total)), F.lit(0.0))

    return curve.select(
        "threshold",
        "tp",
        "fp",
        share("tp", totals["positives"]).alias("tpr"),
        share("fp", totals["negatives"]).alias("fpr"),
    )
