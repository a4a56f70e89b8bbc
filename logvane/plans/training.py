"""Offline training as one Spark job: split, fit, tune, evaluate, release."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.functions.coerce import clean_label, read_number
from logvane.operators.evaluation import (
    METRIC_COLUMNS,
    evaluate,
    recall_by_type,
)
from logvane.operators.forest import IsolationForest, classify
from logvane.operators.sampling import is_benign, is_train
from logvane.operators.scaler import BaselineScaler
from logvane.operators.scoring import Detector
from logvane.operators.threshold import FPR_BUDGET, tune_threshold
from logvane.schema import FEATURE_COLUMNS, LABEL_COLUMN
from logvane.session import materialize
from logvane.sources.release import save_model, write_card


@dataclass(frozen=True)
class TrainingResult:
    detector: Detector
    evaluated: DataFrame
    metrics: dict
    flag_rate: float
    benign_rows: int
    attack_rows: int
    # Every flow: its ids, event_type, part and normality.
    scored: DataFrame


def _stored_parts(flows: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """What training needs, written once: all its passes re-read this copy.

    ``part`` is train or test for benign rows and attack for all others.
    """
    numbers = [read_number(flows, c).alias(c) for c in columns]
    kind = clean_label(F.col(LABEL_COLUMN)).alias("event_type")
    part = F.when(~is_benign(), F.lit("attack")).when(is_train(ids), F.lit("train"))
    return materialize(
        flows.select(*ids, kind, part.otherwise(F.lit("test")).alias("part"), *numbers)
    )


def train(
    flows: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str] = FEATURE_COLUMNS,
    fit_on: str = "train",
    budget: float = FPR_BUDGET,
    **forest_options,
) -> TrainingResult:
    """Fit a detector on benign training flows and tune its alert threshold.

    ``fit_on`` chooses the rows that teach the scaler: the benign training
    split, or ``"all_benign"``, which also shows it the held-out benign rows.
    """
    columns = list(columns)
    stored = _stored_parts(flows, list(ids), columns)
    benign_train = stored.where(F.col("part") == "train")
    scaler = BaselineScaler(columns).fit(
        stored.where(F.col("part") != "attack") if fit_on == "all_benign" else benign_train
    )
    estimator = IsolationForest(list(ids), feature_names=columns, **forest_options)
    grown, rows = estimator.grow(scaler.transform(benign_train).select(*ids, "scaled"))
    # Every row walks the forest once; calibration, threshold and evaluation read this copy.
    normality = grown.normality(scaler.scaled({c: F.col(f"`{c}`") for c in columns}))
    walked = materialize(stored.select(*ids, "event_type", "part", normality.alias("normality")))
    forest = estimator.calibrate(grown, walked.where(F.col("part") == "train").select("normality"), rows)
    flag_rate = forest.self_flag_rate
    scored = walked.where(F.col("part") != "train").select(
        *ids,
        "event_type",
        F.when(F.col("part") == "attack", F.lit(1)).otherwise(F.lit(0)).alias("is_attack"),
        forest.anomaly_score(forest.decision(F.col("normality"))).alias("anomaly_score"),
    )
    forest = forest.with_threshold(tune_threshold(scored, budget=budget))
    evaluated = scored.withColumn(
        "prediction", classify(F.col("anomaly_score"), forest.threshold).cast("int")
    )
    metrics = evaluate(evaluated).first().asDict()
    return TrainingResult(
        Detector(scaler, forest),
        evaluated,
        {c: metrics[c] for c in METRIC_COLUMNS},
        flag_rate,
        metrics["tn"] + metrics["fp"],
        metrics["tp"] + metrics["fn"],
        walked,
    )


def recall_table(result: TrainingResult) -> DataFrame:
    return recall_by_type(result.evaluated.where(F.col("is_attack") == 1))


def release(
    result: TrainingResult,
    path: str,
    artifact_version: str,
    budget: float = FPR_BUDGET,
    training_data: dict | None = None,
    limitations: list[str] | None = None,
) -> dict:
    """Save the model, then write the card that binds the saved files."""
    spark = result.evaluated.sparkSession
    forest = result.detector.forest
    save_model(spark, result.detector, path)
    scaler = result.detector.scaler
    facts = {
        "artifact_version": artifact_version,
        "training": (
            forest.seed,
            forest.n_features,
            scaler.columns,
            forest.trees,
            forest.contamination,
        ),
        "evaluation": (
            forest.threshold,
            budget,
            (result.benign_rows, result.attack_rows),
            {name: float(value) for name, value in result.metrics.items()},
            result.flag_rate,
        ),
        "training_data": training_data,
        "limitations": limitations or [],
    }
    return write_card(spark, path, facts)
