"""What training and the wide queries do once for each row."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logvane.operators.forest import IsolationForestModel, _not_finite
from logvane.plans.training import train
from logvane.schema import FEATURE_COLUMNS


def flows(spark, rows=1500):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(rows, len(FEATURE_COLUMNS))), columns=FEATURE_COLUMNS)
    attack = rng.random(rows) < 0.2
    pdf.loc[attack, FEATURE_COLUMNS] += 6.0
    pdf["Label"] = np.where(attack, "DoS Hulk", " BENIGN ")
    pdf["flow_id"] = [f"f{i}" for i in range(rows)]
    return spark.createDataFrame(pdf)


def test_training_walks_every_row_once_and_hands_out_its_scores(spark, monkeypatch):
    df, walks, normality = flows(spark), [], IsolationForestModel.normality

    def spied(self, scaled):
        walks.append(self)
        return normality(self, scaled)

    monkeypatch.setattr(IsolationForestModel, "normality", spied)
    result = train(df, ["flow_id"])
    assert len(walks) == 1
    forest = result.detector.forest
    columns = ["flow_id", "decision", "anomaly_score", "is_outlier", "is_alert"]
    once = forest.judged(result.scored).select(columns)
    anew = forest.transform(result.detector.scaler.transform(df)).select(columns)
    assert sorted(once.collect()) == sorted(anew.collect())
    assert result.benign_rows + result.attack_rows == result.evaluated.count()
    assert once.count() == df.count()


@pytest.mark.parametrize(
    "values, bad",
    [([1.0, -2.0], False), ([], False), (None, None), ([1.0, None], True), ([None], True), ([math.nan], True),
     ([1.0, math.inf], True), ([-math.inf, 1.0], True), ([None, math.inf], True)],
)
def test_not_finite(spark, values, bad):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert bool(df.select(_not_finite(F.col("v"))).first()[0]) == bool(bad)
