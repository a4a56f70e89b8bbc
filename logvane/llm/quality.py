"""Quality scores from a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Its
covariance is shrunk towards the pooled one and towards a multiple of the
identity, and its Cholesky factor is inverted once, so that a score costs two
small matrix products: the difference of two Mahalanobis log densities.

Statistics are computed once for each text and written to the checkpoint
folder; the classes' moments are sums that combine on the map side, so the
driver gets one row for each class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, texts_of
from logvane.session import materialize

STATISTICS = (
    "chars words word_length capitals digits symbols marks stops bars repeats variety "
    "line_repeats short_words entropy"
).split()
TO_POOLED = 0.10
TO_IDENTITY = 0.02
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.uint8)
for _k, _signs in enumerate((b"0123456789", b"#*$%&<>@^~=_+\\{}[]", b"!?", b".,;:", b"|"), 2):
    _CLASSES[list(_signs)] = _k
_CLASSES[65:91] = 1


def _share(part: float, whole: float) -> float:
    """Logarithm of a share, held down in short texts, where one sign more says little."""
    return math.log(part / (whole + 20) + 0.005)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty text has them too."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    seen = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASSES, weights=seen, minlength=7)
    capitals = kinds[1] if text.isascii() else sum(map(str.isupper, text))
    words = text.split()
    count = len(words)
    distinct = Counter(words)
    repeats = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    share = seen[seen > 0] / max(n, 1)
    letters = max(len(text) - kinds[2:].sum() - seen[32] - seen[10], 0)
    return [
        math.log1p(len(text)),
        math.log1p(count),
        math.log1p((len(text) - count) / max(count, 1)),
        _share(capitals, letters),
        _share(kinds[2], n),
        _share(kinds[3], n),
        _share(kinds[4], n),
        _share(kinds[5], n),
        _share(kinds[6], n),
        _share(repeats, count),
        math.log((len(distinct) + 1) / (count + 1)),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(sum(c for w, c in distinct.items() if len(w) < 3), count),
        float(-(share * np.log(share)).sum()),
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row's whole text (null: empty), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in texts_of(batches):
            columns = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", *STATISTICS])

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    kinds = ", ".join(f"{name} double" for name in STATISTICS)
    return materialize(rows.mapInArrow(run, f"doc_id {kind}, {kinds}"))


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log densities' constants of classes 0 and 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if len(self.means) < 2:  # a class without labelled rows: nothing speaks for either
            return np.full(len(x), 0.5)
        low, high = (
            c - 0.5 * np.square((x - m) @ f.T).sum(axis=1)
            for m, f, c in zip(self.means, self.factors, self.constants)
        )
        return 1 / (1 + np.exp(np.clip(low - high, -60, 60)))


def fit(
    features: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    to_pooled: float = TO_POOLED,
    to_identity: float = TO_IDENTITY,
) -> Discriminant:
    """Learn from labelled rows; null labels are left out, repeated ones count again."""
    known = labels.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).where("label in (0, 1)")
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
    moments = (
        features.join(known, "doc_id")
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)],
            *[F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    sums = {r["label"]: r for r in moments}
    if set(sums) != {0, 1}:
        return Discriminant([], [], [])
    size = len(STATISTICS)
    counts = np.array([sums[k]["n"] for k in (0, 1)], float)
    means = [np.array([sums[k][f"s{i}"] for i in range(size)]) / sums[k]["n"] for k in (0, 1)]
    spreads = []
    for k in (0, 1):
        product = np.zeros((size, size))
        for i, j in pairs:
            product[i, j] = product[j, i] = sums[k][f"p{i}_{j}"] / sums[k]["n"]
        spreads.append(product - np.outer(means[k], means[k]))
    pooled = (spreads[0] * counts[0] + spreads[1] * counts[1]) / counts.sum()
    # Unit variances first, so that shrinking towards the identity treats statistics alike.
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, constants = [], []
    for k in (0, 1):
        few = size / (size + counts[k])  # a class of few rows leans more on the pooled spread
        weight = to_pooled + (1 - to_pooled) * few
        spread = ((1 - weight) * spreads[k] + weight * pooled) / np.outer(scale, scale)
        ridge = max(np.trace(spread) / size, 1e-3)
        lower = np.linalg.cholesky((1 - to_identity) * spread + to_identity * ridge * np.eye(size))
        factors.append(np.linalg.inv(lower) / scale)
        constants.append(float(np.log(counts[k] / counts.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, constants)


def score(features: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted class of every row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            p = model.score(x)
            predicted = pa.array((p >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), predicted], ["doc_id", "score", "predicted"]
            )

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", *STATISTICS).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Score all documents with a model learned from ``labels``.

    Only the text enters a score. Null and empty texts are scored from the
    statistics of an empty text; without labels of both classes every score is
    0.5. Repeated rows are scored each by itself, and extra columns are ignored.
    """
    features = text_statistics(docs, id_col, text_col)
    return score(features, fit(features, labels, label_col, id_col), threshold)
