import math

import numpy as np
import pandas as pd
import pytest
from conftest import normal_frame
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from logvane.operators import evaluation
from logvane.operators.forest import IsolationForest, classify, mean_path
from logvane.operators.scaler import BaselineScaler, clean_rows
from logvane.operators.scoring import (
    Detector,
    score_feature_maps,
    score_logs,
    with_top_deviations,
)
from logvane.operators.threshold import allowed_false_positives, roc_curve, tune_threshold
from logvane.schema import FEATURE_COLUMNS


def uniform_frame(rows, seed=42):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {c: rng.uniform(0, 100 * (i + 1), rows) for i, c in enumerate(FEATURE_COLUMNS)}
    )


def scaled_matrix(model, df):
    return np.array([r["scaled"] for r in model.transform(df).select("scaled").collect()])


def test_scaler_learns_the_benign_baseline(spark):
    pdf = uniform_frame(500)
    df = spark.createDataFrame(pdf)
    model = BaselineScaler().fit(df)
    z = scaled_matrix(model, df)
    assert z.shape == (500, 18)
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0), 1)
    medians = [p.median for p in model.feature_params]
    assert np.allclose(medians, pdf.median().to_numpy(), rtol=1e-12)


def test_scaler_drops_dirty_rows_at_fit_and_imputes_later(spark):
    pdf = uniform_frame(150)
    pdf.loc[0, "Flow Bytes/s"] = math.inf
    pdf.loc[1, "Flow Packets/s"] = math.nan
    df = spark.createDataFrame(pdf)
    assert clean_rows(df, FEATURE_COLUMNS).count() == 148
    model = BaselineScaler().fit(df)
    assert model.fitted_rows == 148
    z = scaled_matrix(model, df)
    assert len(z) == 150 and np.isfinite(z).all()
    params = {p.feature: p for p in model.feature_params}["Flow Bytes/s"]
    assert math.inf not in z and (params.median - params.mean) / params.scale in z[:, 1]


def test_scaler_guards(spark):
    with pytest.raises(ValueError):
        BaselineScaler().fit(spark.createDataFrame(uniform_frame(50)))
    with pytest.raises(KeyError):
        BaselineScaler().fit(spark.createDataFrame(uniform_frame(150)).drop("Flow Duration"))
    model = BaselineScaler().fit(spark.createDataFrame(uniform_frame(150)))
    with pytest.raises(KeyError):
        model.transform(spark.createDataFrame(uniform_frame(5)).drop("Flow Duration"))


def test_constant_feature_keeps_scale_one(spark):
    df = spark.createDataFrame(uniform_frame(150).assign(**{"Flow Duration": 4.0}))
    assert BaselineScaler().fit(df).feature_params[0].scale == 1.0


def matrix(spark, rows, seed, mean=0.0, columns=6):
    values = np.random.default_rng(seed).normal(mean, 1, size=(rows, columns))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "row bigint, scaled array<double>")


@pytest.fixture(scope="module")
def forest(spark):
    return IsolationForest(["row"]).fit(matrix(spark, 300, 42))


def test_outliers_score_higher_and_scores_are_bounded(spark, forest):
    inliers = forest.transform(matrix(spark, 300, 42))
    outliers = forest.transform(matrix(spark, 20, 7, mean=15.0))
    low, high, mean = inliers.agg(
        F.min("anomaly_score"), F.max("anomaly_score"), F.avg("anomaly_score")
    ).first()
    assert 0 <= low and high <= 1
    assert outliers.agg(F.avg("anomaly_score")).first()[0] > mean
    assert {r[0] for r in inliers.select("is_outlier").distinct().collect()} <= {0, 1}
    assert forest.self_flag_rate == pytest.approx(0.01, abs=0.01)


def test_same_forest_under_any_partitioning(spark):
    one = IsolationForest(["row"]).fit(matrix(spark, 2000, 1).repartition(3))
    two = IsolationForest(["row"]).fit(matrix(spark, 2000, 1).repartition(11))
    pd.testing.assert_frame_equal(one.nodes, two.nodes)
    assert one.offset == two.offset
    assert (one.nodes[one.nodes["node"] == 0]["rows"] == 256).all()
    assert one.trees == 100


def test_subsamples_are_spread_evenly(spark):
    """Every row is equally likely; the one-hash draw must not favour any tree."""
    from logvane.operators.forest import draw_subsamples

    drawn = draw_subsamples(matrix(spark, 20_000, 1, columns=1), ["row"], 20_000, 100, 256, 9)
    counts = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert counts == [256] * 100
    # 1.28 draws per row on average; independent trees make that Poisson.
    often = drawn.groupBy("scaled").count().where("count > 3").count()
    assert abs(often - 826) < 120
    quarter = drawn.where(F.col("scaled")[0] < -0.6745).count()
    assert abs(quarter / 25_600 - 0.25) < 0.015


def test_forest_guards(spark, forest):
    with pytest.raises(ValueError):
        IsolationForest(["row"]).fit(matrix(spark, 50, 1))
    bad = matrix(spark, 150, 1).withColumn("scaled", F.array(*[F.lit(float("nan"))] * 6))
    with pytest.raises(ValueError):
        IsolationForest(["row"]).fit(bad)
    with pytest.raises(ValueError):
        forest.normality([F.lit(0.0)] * 5)
    for wrong in (-0.1, 1.1):
        with pytest.raises(ValueError):
            forest.with_threshold(wrong)
    with pytest.raises(RuntimeError):
        IsolationForest(["row"]).fit(matrix(spark, 700, 1).withColumn("row", F.lit(1)))


def test_threshold_decides_alerts(spark, forest):
    df = matrix(spark, 300, 42)
    assert forest.with_threshold(0.0).transform(df).where("NOT is_alert").count() == 0
    strict = forest.with_threshold(0.9).transform(df).where("is_alert").count()
    assert strict < forest.with_threshold(0.1).transform(df).where("is_alert").count()


def test_score_is_computed_once_per_row(spark, forest):
    plan = forest.transform(matrix(spark, 300, 42)).where("is_alert AND anomaly_score > 0.2")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_mean_path_values():
    assert mean_path(1) == 0 and mean_path(2) == 1
    assert mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_stages_compose_in_an_ml_pipeline(spark):
    df = spark.createDataFrame(normal_frame(300))
    stages = [BaselineScaler(), IsolationForest(["row"])]
    scored = Pipeline(stages=stages).fit(df).transform(df)
    assert scored.where("anomaly_score IS NULL").count() == 0


def brute_threshold(benign, attack, budget):
    best = None
    for t in sorted(set(benign) | set(attack), reverse=True):
        if sum(b >= t for b in benign) / len(benign) <= budget:
            tp = sum(a >= t for a in attack)
            if best is None or tp > best[0]:
                best = (tp, t)
    return best[1] if best and best[0] else None


@pytest.mark.parametrize("seed", range(6))
def test_tuned_threshold_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    digits = int(rng.integers(1, 4))
    benign = [float(x) for x in rng.random(80 + seed).round(digits)]
    attack = [float(x) for x in (rng.random(50) * 1.2).round(digits)]
    rows = [(0, b) for b in benign] + [(1, a) for a in attack]
    df = spark.createDataFrame(rows, "is_attack int, anomaly_score double")
    budget = float(rng.choice([0.0, 0.05, 0.2]))
    expected = brute_threshold(benign, attack, budget)
    for ranked_rows in (1, 200_000):
        if expected is None:
            with pytest.raises(ValueError):
                tune_threshold(df, budget=budget, ranked_rows=ranked_rows)
        else:
            assert tune_threshold(df, budget=budget, ranked_rows=ranked_rows) == expected


def test_no_attack_within_budget_is_an_error(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1)], "is_attack int, anomaly_score double")
    with pytest.raises(ValueError):
        tune_threshold(df, budget=0.0)


def test_allowed_false_positives_is_exact():
    assert allowed_false_positives(9093, 0.05) == 454
    assert allowed_false_positives(20, 0.05) == 1
    assert allowed_false_positives(10, 1.0) == 10


def test_roc_curve_counts(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (1, 0.1)]
    df = spark.createDataFrame(rows, "is_attack int, anomaly_score double")
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in roc_curve(df).collect()}
    assert got == {0.8: (1, 0), 0.4: (2, 1), 0.1: (3, 2)}


def metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "is_attack int, prediction int")
    return evaluation.evaluate(df).first().asDict()


def test_metrics_of_the_published_counts(spark):
    counts = spark.createDataFrame([(4478, 8640, 453, 8349)], "tp bigint, tn bigint, fp bigint, fn bigint")
    got = evaluation.metrics_of(counts).first()
    assert got["precision"] == pytest.approx(0.9081322247008721)
    assert got["recall"] == pytest.approx(0.3491073516800499)
    assert got["f1"] == pytest.approx(0.504336073882194)
    assert got["fpr"] == pytest.approx(0.04981854173540086)
    assert got["adjusted_precision"] == pytest.approx(0.6307667591899822)


def test_metric_edges(spark):
    assert metrics(spark, [(1, 1), (0, 0)])["f1"] == 1.0
    none = metrics(spark, [(1, 0), (0, 0)])
    assert (none["precision"], none["recall"], none["f1"], none["adjusted_precision"]) == (0, 0, 0, 0)


def scored(spark, detector, maps, gate=False):
    df = spark.createDataFrame(
        [(i, m) for i, m in enumerate(maps)], "id int, features map<string,double>"
    )
    run = score_logs if gate else score_feature_maps
    return {r["id"]: r for r in run(df, detector).collect()}


def full(value):
    return {c: float(value) for c in FEATURE_COLUMNS}


def test_scoring_feature_maps(spark, detector):
    shifted = {**full(0), "Flow Bytes/s": 30.0, "Down/Up Ratio": -50.0}
    rows = scored(spark, detector, [full(0), full(40), shifted, {"Flow Duration": 1.0}, {}, {"x": 9.0}])
    assert rows[1]["is_alert"] and not rows[0]["is_alert"]
    assert rows[1]["anomaly_score"] > rows[0]["anomaly_score"]
    top = rows[2]["top_features"]
    assert [f["feature"] for f in top[:2]] == ["Down/Up Ratio", "Flow Bytes/s"]
    assert len(top) == 5 and top[0]["deviation"] < 0
    sizes = [abs(f["deviation"]) for f in top]
    assert sizes == sorted(sizes, reverse=True)
    # An empty map and one with unknown keys only are both the median row.
    assert rows[4]["anomaly_score"] == rows[5]["anomaly_score"]
    assert all(r["anomaly_score"] is not None for r in rows.values())


def test_deviations_are_ranked_alike_with_and_without_a_forest(spark, detector):
    rng = np.random.default_rng(4)
    maps = [{c: float(v) for c, v in zip(FEATURE_COLUMNS, rng.normal(size=18).round(1))} for _ in range(200)]
    df = spark.createDataFrame([(m,) for m in maps], "features map<string,double>")
    raw = {c: F.col("features")[c] for c in FEATURE_COLUMNS}
    alone = with_top_deviations(df, FEATURE_COLUMNS, detector.scaler.scaled(raw)).withColumnRenamed(
        "top_features", "alone"
    )
    both = score_feature_maps(alone, detector).collect()
    assert len(both) == 200
    for row in both:
        z = {p.feature: (row["features"][p.feature] - p.mean) / p.scale for p in detector.scaler.feature_params}
        want = sorted(FEATURE_COLUMNS, key=lambda c: -abs(z[c]))[:5]
        assert [f["feature"] for f in row["top_features"]] == want
        assert row["alone"] == row["top_features"]


def test_rows_without_features_take_no_walk(spark, detector):
    """A filter on scorable rows leaves the others' scores unset, in whatever order they come."""
    rows = scored(spark, detector, [{}, full(40), None, full(0), {}], gate=True)
    alone = scored(spark, detector, [full(40), full(0)], gate=True)
    assert [rows[1]["anomaly_score"], rows[3]["anomaly_score"]] == [alone[0]["anomaly_score"], alone[1]["anomaly_score"]]
    assert rows[0]["anomaly_score"] is None and rows[0]["top_features"] == []


def test_short_trees_are_drawn_again(spark):
    """Eight of a thousand rows: some trees draw too few at first; the forest is the same under any partitioning."""
    frame = spark.createDataFrame(normal_frame(1000))
    scaled = frame.select("row", F.array(*[F.col(f"`{c}`") for c in FEATURE_COLUMNS]).alias("scaled"))
    fits = [IsolationForest(["row"], subsample=8).fit(scaled.repartition(n)) for n in (2, 5)]
    assert fits[0].nodes.equals(fits[1].nodes)
    roots = fits[0].nodes[fits[0].nodes["node"] == 0]
    assert len(roots) == 100 and (roots["rows"] == 8).all()


def test_logs_without_features_or_model_stay_unscored(spark, detector):
    rows = scored(spark, detector, [full(40), {}, None], gate=True)
    assert rows[0]["is_alert"]
    for i in (1, 2):
        assert rows[i]["anomaly_score"] is None and rows[i]["is_alert"] is False
        assert rows[i]["top_features"] == []
    assert scored(spark, None, [full(40)], gate=True)[0]["anomaly_score"] is None


def test_mismatched_parts_are_refused(spark, detector, forest):
    with pytest.raises(ValueError):
        Detector(detector.scaler, forest)
