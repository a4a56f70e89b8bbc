"""Score logs that carry a feature map and explain the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.forest import IsolationForestModel, classify, largest_places
from logvane.operators.scaler import BaselineScalerModel
from logvane.schema import TOP_FEATURE_TYPE

# Fixed value: deviations shown per log.
TOP_FEATURES = 5


@dataclass(frozen=True)
class Detector:
    """Everything scoring needs: preprocessing and a calibrated forest."""

    scaler: BaselineScalerModel
    forest: IsolationForestModel

    def __post_init__(self):
        if len(self.scaler.columns) != self.forest.n_features:
            raise ValueError(
                f"the scaler has {len(self.scaler.columns)} features; "
                f"the forest was fit on {self.forest.n_features}"
            )


def _named(names: list[str], places: Column, deviations: Column) -> Column:
    """(feature, deviation) of the given places, rounded."""
    return F.transform(
        places,
        lambda place: F.struct(
            F.element_at(F.lit(names), place + 1).alias("feature"),
            F.round(F.element_at(deviations, place + 1), 2).alias("deviation"),
        ),
    )


def with_top_deviations(
    df: DataFrame, names: list[str], scaled: list[Column], count: int = TOP_FEATURES
) -> DataFrame:
    """Add ``top_features``: the largest absolute standard scores first; ties keep feature order."""
    count = min(count, len(names))

    @F.pandas_udf("array<int>")
    def ranked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            values = np.stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.Series(list(largest_places(values, count)))

    held = df.withColumn("_z", F.array(*scaled))
    places = ranked(*[F.col("_z")[i] for i in range(len(names))])
    placed = held.withColumn("_places", places)
    return placed.withColumn("top_features", _named(names, F.col("_places"), F.col("_z"))).drop("_z", "_places")


def score_feature_maps(
    df: DataFrame, detector: Detector, features: str = "features", scorable: Column | None = None
) -> DataFrame:
    """Add ``anomaly_score``, ``is_alert`` and ``top_features`` to every row.

    Keys missing from a map are imputed, unknown keys are ignored. What is added
    to rows that are not ``scorable`` means nothing.
    """
    names = detector.scaler.columns
    raw = {name: F.col(features)[name] for name in names}
    scored = df.withColumn("_z", F.array(*detector.scaler.scaled(raw)))
    forest = detector.forest
    z = [F.col("_z")[i] for i in range(len(names))]
    ranked = forest.ranked_normality(z, min(TOP_FEATURES, len(names)), scorable)
    scored = scored.withColumn("_score", ranked)
    score = forest.anomaly_score(forest.decision(F.col("_score.normality")))
    return (
        scored.withColumn("anomaly_score", score)
        .withColumn("is_alert", classify(F.col("anomaly_score"), forest.threshold))
        .withColumn("top_features", _named(names, F.col("_score.places"), F.col("_z")))
        .drop("_z", "_score")
    )


def score_logs(df: DataFrame, detector: Detector | None, features: str = "features") -> DataFrame:
    """Score the logs that carry features; the others stay unscored.

    Without a detector every log passes through unscored.
    """
    if detector is None:
        return df.withColumns(
            {
                "anomaly_score": F.lit(None).cast("double"),
                "is_alert": F.lit(False),
                "top_features": F.array().cast(TOP_FEATURE_TYPE),
            }
        )
    has_features = F.coalesce(F.size(features) > 0, F.lit(False))
    scored = score_feature_maps(df.withColumn("_has", has_features), detector, features, F.col("_has"))
    return scored.withColumns(
        {
            "anomaly_score": F.when(F.col("_has"), F.col("anomaly_score")),
            "is_alert": F.col("_has") & F.col("is_alert"),
            "top_features": F.when(F.col("_has"), F.col("top_features")).otherwise(
                F.array().cast(TOP_FEATURE_TYPE)
            ),
        }
    ).drop("_has")
