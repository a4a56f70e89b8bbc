"""Isolation forest (Liu, Ting & Zhou 2008) trained and applied by Spark.

Each tree sees a bounded random subsample, so training ships at most
``trees x subsample`` rows, one small group per tree. Scoring keeps the rows in
the JVM and sends only the scaled features to a vectorized function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvane.functions.hashing import unit_interval
from logvane.operators.quantiles import bracket, exact_quantiles
from logvane.session import materialize

MIN_ROWS = 100
# The operating point.
TREES = 100
SUBSAMPLE = 256
CONTAMINATION = 0.01
SEED = 42
SPREAD_DEVIATIONS = 4.0
DEFAULT_THRESHOLD = 0.5
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.LongType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("rows", T.LongType()),
    ]
)


def mean_path(rows: int) -> float:
    """Average path length of an unsuccessful search among ``rows`` rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + EULER_GAMMA) - 2.0 * (rows - 1) / rows


def depth_limit(subsample: int) -> int:
    return math.ceil(math.log2(max(subsample, 2)))


def _draw(
    keyed: DataFrame, trees: list[int], chance: float, wanted: int, seed: int
) -> DataFrame:
    """Every (row, tree) pair by an independent draw; at most ``wanted`` rows of each tree stay.

    The first of the trees that a row meets follows a geometric law, so one
    hash per row decides whether it is drawn at all; only the few drawn rows
    look at other trees.
    """
    if chance < 1.0:
        miss_all = math.exp(len(trees) * math.log1p(-chance))
        draw = unit_interval(seed, F.col("row_id"))
        first = F.floor(F.log1p(-F.col("draw")) / F.lit(math.log1p(-chance))).cast("int")
        keyed = (
            keyed.withColumn("draw", draw)
            .where(F.col("draw") < F.lit(1.0 - miss_all))
            .withColumn("first", F.least(first, F.lit(len(trees) - 1)))
        )
    else:
        keyed = keyed.withColumn("first", F.lit(0))
    later = F.filter(
        F.sequence(F.lit(0), F.lit(len(trees) - 1)),
        lambda t: (t == F.col("first"))
        | (
            (t > F.col("first"))
            & (unit_interval(seed + 1, t, F.col("row_id")) < F.lit(chance))
        ),
    )
    tree = F.element_at(F.lit(trees), F.col("turn") + 1)
    drawn = (
        keyed.select("row_id", "scaled", F.explode(later).alias("turn"))
        .select("row_id", "scaled", tree.alias("tree"))
        .withColumn("pick", F.xxhash64(F.lit(seed + 2), "tree", "row_id"))
    )
    order = Window.partitionBy("tree").orderBy("pick", "row_id", "scaled")
    placed = drawn.withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= wanted).select("tree", "place", "scaled")


def draw_subsamples(
    df: DataFrame, ids: list[str], rows: int, trees: int, subsample: int, seed: int
) -> DataFrame:
    """``min(subsample, rows)`` rows for every tree, without replacement.

    A pair is drawn with about twice the chance needed, and the smallest hashes
    of each tree are kept. A tree that drew too few rows is drawn anew with
    double the chance and hashes of its own, until all trees are full; at a chance of one
    every row is drawn. All of it depends on hashes and counts alone, so the
    trees are the same under any partitioning.
    """
    wanted = min(subsample, rows)
    chance = 1.0 if rows <= 2 * subsample else 2.0 * subsample / rows
    row_id = F.xxhash64(*[F.col(f"`{c}`") for c in ids])
    keyed = df.select(row_id.alias("row_id"), "scaled")
    short, full, turn = list(range(trees)), None, 0
    while short:
        # At most subsample rows of each tree; written, so that the count and the trees see one draw.
        drawn = materialize(_draw(keyed, short, chance, wanted, seed + 1000 * turn))
        counts = drawn.groupBy("tree").count().where(F.col("count") == wanted).collect()
        done = {r["tree"] for r in counts}
        kept = drawn.where(F.col("tree").isin(sorted(done))) if len(done) < len(short) else drawn
        full = kept if full is None else full.unionByName(kept)
        short = [t for t in short if t not in done]
        if short and chance >= 1.0:
            raise RuntimeError("a tree drew too few rows; are the id columns unique?")
        chance, turn = min(1.0, 2 * chance), turn + 1
    return full


def _grow(sample: np.ndarray, tree: int, limit: int, seed: int) -> pd.DataFrame:
    """Split one tree's rows at random until isolated or at the depth limit."""
    random = np.random.default_rng([seed, tree])
    nodes = []
    waiting = [(0, 0, sample)]
    while waiting:
        node, depth, rows = waiting.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((tree, node, -1, math.nan, len(rows)))
            continue
        feature = int(random.choice(varying))
        threshold = float(random.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        nodes.append((tree, node, feature, threshold, len(rows)))
        left = rows[:, feature] <= threshold
        waiting.append((2 * node + 2, depth + 1, rows[~left]))
        waiting.append((2 * node + 1, depth + 1, rows[left]))
    return pd.DataFrame(nodes, columns=NODE_SCHEMA.names)


def grow_trees(subsamples: DataFrame, limit: int, seed: int) -> DataFrame:
    """Grow all trees in parallel, one bounded group per tree."""

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        return _grow(np.stack(group["scaled"].to_numpy()), int(group["tree"].iloc[0]), limit, seed)

    return subsamples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def pack_forest(nodes: pd.DataFrame, limit: int) -> dict[str, np.ndarray]:
    """Node table as complete-binary-tree arrays, one row per tree.

    A leaf above the bottom level hands its path length down to all bottom
    positions under it, so every walk takes the same number of steps.
    """
    trees = np.sort(nodes["tree"].unique())
    inner, bottom = 2**limit - 1, 2**limit
    feature = np.zeros((len(trees), inner), dtype=np.int64)
    threshold = np.full((len(trees), inner), np.inf)
    path = np.full((len(trees), inner + bottom), np.nan)
    tree = np.searchsorted(trees, nodes["tree"].to_numpy())
    node = nodes["node"].to_numpy(dtype=np.int64)
    split = nodes["feature"].to_numpy() >= 0
    feature[tree[split], node[split]] = nodes["feature"].to_numpy()[split]
    threshold[tree[split], node[split]] = nodes["threshold"].to_numpy()[split]
    depth = np.floor(np.log2(node[~split] + 1))
    path[tree[~split], node[~split]] = depth + [
        mean_path(int(rows)) for rows in nodes["rows"].to_numpy()[~split]
    ]
    for place in range(1, inner + bottom):
        above = path[:, (place - 1) // 2]
        path[:, place] = np.where(np.isnan(path[:, place]), above, path[:, place])
    return {"feature": feature, "threshold": threshold, "path": path[:, inner:].copy()}


def mean_depths(forest: dict[str, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Mean path length of each row; ``columns`` is features x rows."""
    rows = columns.shape[1]
    values = columns.reshape(-1)
    offset = np.arange(rows)
    total = np.zeros(rows)
    bottom = forest["path"].shape[1]
    steps = bottom.bit_length() - 1
    # Every step writes into the same few arrays; places are valid by construction.
    node, at = np.empty(rows, np.int64), np.empty(rows, np.int64)
    value, limit, right = np.empty(rows), np.empty(rows), np.empty(rows, bool)
    for feature, threshold, path in zip(forest["feature"], forest["threshold"], forest["path"]):
        start = feature * rows
        np.greater(columns[feature[0]], threshold[0], out=right)
        np.add(right, 1, out=node)
        for _ in range(steps - 1):
            start.take(node, out=at, mode="clip")
            at += offset
            values.take(at, out=value, mode="clip")
            threshold.take(node, out=limit, mode="clip")
            np.greater(value, limit, out=right)
            node *= 2
            node += 1
            node += right
        node -= bottom - 1
        total += path.take(node, out=value, mode="clip")
    return total / len(forest["path"])


def largest_places(columns: np.ndarray, count: int) -> np.ndarray:
    """Per row the places of the largest absolute values, largest first; equal ones stay in feature order.

    ``columns`` is features x rows, the result rows x ``count``.
    """
    return np.argsort(-np.abs(columns.T), axis=1, kind="stable")[:, :count].astype(np.int32)


def _not_finite(values: Column) -> Column:
    """Whether an array holds an infinite, NaN or missing number, without a lambda for every element.

    Spark orders NaN above infinity, and looking for a number among nulls gives null.
    """
    infinity = F.lit(float("inf"))
    beyond = (F.array_max(values) >= infinity) | (F.array_min(values) <= -infinity)
    return F.coalesce(beyond, F.lit(False)) | (values.isNotNull() & F.array_contains(values, infinity).isNull())


class IsolationForest(Estimator):
    """Fits on scaled, benign rows carrying ``scaled`` and unique id columns.

    The rows are read in three passes: pass a stored frame.
    """

    def __init__(
        self,
        ids: list[str],
        trees: int = TREES,
        subsample: int = SUBSAMPLE,
        contamination: float = CONTAMINATION,
        seed: int = SEED,
        feature_names: list[str] | None = None,
    ):
        super().__init__()
        self.ids = list(ids)
        self.trees = trees
        self.subsample = subsample
        self.contamination = contamination
        self.seed = seed
        self.feature_names = feature_names

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        train = dataset.select(*[F.col(f"`{c}`") for c in self.ids], "scaled")
        bare, rows = self.grow(train)
        return self.calibrate(bare, materialize(train.select(bare.normality("scaled").alias("normality"))), rows)

    def grow(self, train: DataFrame) -> tuple[IsolationForestModel, int]:
        """The forest without its calibration, and the number of training rows."""
        row_id = F.xxhash64(*[F.col(f"`{c}`") for c in self.ids])
        rows, different, bad, narrowest, widest = train.agg(
            F.count("*"),
            F.approx_count_distinct(row_id),
            F.count_if(_not_finite(F.col("scaled"))),
            F.min(F.size("scaled")),
            F.max(F.size("scaled")),
        ).first()
        if rows < MIN_ROWS:
            raise ValueError(f"only {rows} rows; at least {MIN_ROWS} are needed to fit a forest")
        # Far more than the estimate's error: rows that share an id would be drawn together.
        if different < 0.75 * rows:
            raise RuntimeError(f"about {different} different ids for {rows} rows; are the id columns unique?")
        if bad:
            raise ValueError(f"{bad} rows hold infinite or missing features")
        if narrowest != widest:
            raise ValueError("rows differ in their number of features")
        wanted = min(self.subsample, rows)
        nodes = grow_trees(
            draw_subsamples(train, self.ids, rows, self.trees, self.subsample, self.seed),
            depth_limit(wanted),
            self.seed,
        ).toPandas()  # at most trees * 2 * subsample rows
        bare = IsolationForestModel(
            nodes,
            subsample=wanted,
            n_features=widest,
            contamination=self.contamination,
            seed=self.seed,
            feature_names=self.feature_names,
        )
        return bare, rows

    def calibrate(self, bare: IsolationForestModel, scores: DataFrame, rows: int) -> IsolationForestModel:
        """The forest with the boundary and spread of its ``normality`` on the training rows; pass a stored frame."""
        deviation, around = scores.agg(
            F.stddev_pop("normality"), bracket("normality", self.contamination)
        ).first()
        offset = exact_quantiles(
            scores, ["normality"], self.contamination, {"normality": rows}, brackets={"normality": tuple(around)}
        )["normality"]
        model = bare.calibrated(offset, deviation if deviation > 0 else 1.0)
        flagged = scores.agg(F.count_if(model.decision(F.col("normality")) < 0)).first()[0]
        model.self_flag_rate = flagged / rows
        return model


class IsolationForestModel(Model):
    """Fitted forest with its calibration and alert threshold."""

    def __init__(
        self,
        nodes: pd.DataFrame,
        subsample: int,
        n_features: int,
        contamination: float = CONTAMINATION,
        seed: int = SEED,
        feature_names: list[str] | None = None,
        offset: float = math.nan,
        deviation: float = math.nan,
        threshold: float = DEFAULT_THRESHOLD,
    ):
        super().__init__()
        self.nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        self.subsample = subsample
        self.n_features = n_features
        self.contamination = contamination
        self.seed = seed
        self.feature_names = list(feature_names) if feature_names else None
        self.offset = offset
        self.deviation = deviation
        self.threshold = threshold
        # Share of the training rows beyond the boundary; known after a fit only.
        self.self_flag_rate: float | None = None
        self._packed_broadcast = None

    def _settings(self) -> dict:
        return {
            "subsample": self.subsample,
            "n_features": self.n_features,
            "contamination": self.contamination,
            "seed": self.seed,
            "feature_names": self.feature_names,
            "offset": self.offset,
            "deviation": self.deviation,
            "threshold": self.threshold,
        }

    def calibrated(self, offset: float, deviation: float) -> IsolationForestModel:
        settings = {**self._settings(), "offset": offset, "deviation": deviation}
        return IsolationForestModel(self.nodes, **settings)

    def with_threshold(self, threshold: float) -> IsolationForestModel:
        """The same forest with another operational alert threshold."""
        if not 0.0 <= threshold <= 1.0:
            raise ValueError(f"threshold must be in [0, 1], got {threshold}")
        return IsolationForestModel(self.nodes, **{**self._settings(), "threshold": threshold})

    @property
    def trees(self) -> int:
        return int(self.nodes["tree"].nunique())

    def _packed(self):
        """The forest arrays, shipped once per executor (about 1 MB)."""
        from pyspark.sql import SparkSession

        sc = SparkSession.active().sparkContext
        if self._packed_broadcast is None or self._packed_broadcast[0] is not sc:
            packed = pack_forest(self.nodes, depth_limit(self.subsample))
            self._packed_broadcast = (sc, sc.broadcast(packed))
        return self._packed_broadcast[1]

    def normality(self, scaled: str | list[Column]) -> Column:
        """``-2 ** (-mean depth / c(subsample))``: lower is more anomalous."""
        if isinstance(scaled, str):
            scaled = [F.col(scaled)[i] for i in range(self.n_features)]
        self._check_width(scaled)
        packed = self._packed()
        expected = mean_path(self.subsample)

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = packed.value
            for columns in batches:
                depth = mean_depths(forest, np.stack([c.to_numpy(dtype=float) for c in columns]))
                yield pd.Series(-np.exp2(-depth / expected))

        # Marked so that filters on the score do not score every row twice.
        return score.asNondeterministic()(*scaled)

    def ranked_normality(self, scaled: list[Column], count: int, scorable: Column | None = None) -> Column:
        """``normality`` with the places of the ``count`` largest absolute inputs.

        The inputs are in the workers for scoring anyway, and ordering a batch
        there is far cheaper than sorting one small array per row. Rows that
        are not ``scorable`` take no walk; their normality is 0.
        """
        self._check_width(scaled)
        count = min(count, self.n_features)
        packed = self._packed()
        expected = mean_path(self.subsample)

        @F.pandas_udf("normality double, places array<int>")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            forest = packed.value
            for wanted, *columns in batches:
                values = np.stack([c.to_numpy(dtype=float) for c in columns])
                at = np.flatnonzero(wanted.to_numpy(dtype=bool))
                normality = np.zeros(values.shape[1])
                normality[at] = -np.exp2(-mean_depths(forest, values[:, at]) / expected)
                places = np.zeros((values.shape[1], count), np.int32)
                places[at] = largest_places(values[:, at], count)
                yield pd.DataFrame({"normality": normality, "places": list(places)})

        wanted = F.lit(True) if scorable is None else scorable
        return score.asNondeterministic()(wanted, *scaled)

    def _check_width(self, scaled: list[Column]) -> None:
        if len(scaled) != self.n_features:
            raise ValueError(
                f"{len(scaled)} features given; the forest was fit on {self.n_features}"
            )

    def decision(self, normality: Column) -> Column:
        """Negative beyond the contamination boundary."""
        return normality - F.lit(self.offset)

    def anomaly_score(self, decision: Column) -> Column:
        """Sigmoid in (0, 1); 0.5 is the contamination boundary."""
        return 1.0 / (1.0 + F.exp(decision * F.lit(SPREAD_DEVIATIONS / self.deviation)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add ``decision``, ``anomaly_score``, ``is_outlier`` and ``is_alert``."""
        return self.judged(dataset.withColumn("normality", self.normality("scaled"))).drop("normality")

    def judged(self, walked: DataFrame) -> DataFrame:
        """The same columns for rows whose ``normality`` is known."""
        scored = walked.withColumn("decision", self.decision(F.col("normality")))
        scored = scored.withColumn("anomaly_score", self.anomaly_score(F.col("decision")))
        return scored.withColumn("is_outlier", (F.col("decision") < 0).cast("int")).withColumn(
            "is_alert", classify(F.col("anomaly_score"), self.threshold)
        )


def classify(score: Column, threshold: float) -> Column:
    return score >= F.lit(threshold)
