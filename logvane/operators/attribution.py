"""Which features isolate a row: each split's share of the row's path length.

At a node of depth d that held r training rows the expected path length is
d + c(r). A split changes it by 1 + c(child's rows) - c(node's rows); that change
is the split feature's contribution. Along a walk the changes add up to the
path length minus c(subsample), so over all trees a row's contributions add up
to the mean depth that its score is made of, minus c. Negative ones isolate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from logvane.operators.forest import IsolationForestModel, depth_limit, mean_path


def pack_changes(nodes: pd.DataFrame, limit: int) -> dict[str, np.ndarray]:
    """For each tree: feature and threshold of every node, and what entering a node changes.

    Leaves keep feature -1; walks stop there.
    """
    trees = np.sort(nodes["tree"].unique())
    size = 2 ** (limit + 1) - 1
    feature = np.full((len(trees), size), -1, dtype=np.int64)
    threshold = np.full((len(trees), size), np.inf)
    expected = np.zeros((len(trees), size))
    tree = np.searchsorted(trees, nodes["tree"].to_numpy())
    node = nodes["node"].to_numpy(dtype=np.int64)
    feature[tree, node] = nodes["feature"].to_numpy()
    threshold[tree, node] = nodes["threshold"].to_numpy(dtype=float)
    expected[tree, node] = np.floor(np.log2(node + 1)) + [mean_path(int(r)) for r in nodes["rows"]]
    place = np.arange(1, size)
    change = np.zeros((len(trees), size))
    change[:, 1:] = expected[:, 1:] - expected[:, (place - 1) // 2]
    return {"feature": feature, "threshold": threshold, "change": change}


def contributions(packed: dict[str, np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Mean contribution of each feature; ``columns`` and the result are features x rows."""
    rows = columns.shape[1]
    at = np.arange(rows)
    total = np.zeros(columns.shape)
    for feature, threshold, change in zip(packed["feature"], packed["threshold"], packed["change"]):
        node, walking = np.zeros(rows, np.int64), at
        while len(walking):
            split = feature[node[walking]]
            walking, split = walking[split >= 0], split[split >= 0]
            above = columns[split, walking] > threshold[node[walking]]
            node[walking] = 2 * node[walking] + 1 + above
            total[split, walking] += change[node[walking]]
    return total / len(packed["feature"])


def attribution(forest: IsolationForestModel, scaled: list[Column]) -> Column:
    """Contribution of each feature to the mean depth, in feature order.

    Their sum is the mean depth minus c(subsample).
    """
    if len(scaled) != forest.n_features:
        raise ValueError(f"{len(scaled)} features given; the forest was fit on {forest.n_features}")
    from pyspark.sql import SparkSession

    # As large as the forest's own arrays: trees x 2 x subsample nodes.
    packed = pack_changes(forest.nodes, depth_limit(forest.subsample))
    shared = SparkSession.active().sparkContext.broadcast(packed)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            values = np.stack([c.to_numpy(dtype=float) for c in columns])
            yield pd.Series(list(contributions(shared.value, values).T))

    return explain.asNondeterministic()(*scaled)


def top_contributions(names: list[str], shares: Column, count: int) -> Column:
    """The features that isolate a row most: least contributions first; ties keep feature order."""
    entries = F.transform(
        shares,
        lambda share, i: F.struct(
            share.alias("contribution"), i.alias("position"), F.element_at(F.lit(names), i + 1).alias("feature")
        ),
    )
    isolating = F.filter(F.slice(F.array_sort(entries), 1, count), lambda e: e["contribution"] < 0)
    return F.transform(
        isolating, lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution"))
    )
