"""Language identification from averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed character n-grams, and a
linear softmax over that mean gives the language. Both are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; a
temperature and two rejection limits are then set on rows the descent did not
see. Since mean and linear layer commute, prediction needs one small table of
(buckets x languages) numbers, whose size depends on no input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, keep_only, slices, texts_of

UNKNOWN = "und"
BUCKETS = 1 << 16
SIZES = (2, 3)
DIM = 16
# Bounds of the learning sample: rows for each language, n-grams for each row.
ROWS_PER_LANGUAGE = 1500
GRAMS_PER_ROW = 512
EPOCHS = 12
LEAST_STEPS = 600
BATCH = 32
RATE = 4.0
# Share of right validation rows that each rejection limit may turn away.
MAX_LOST = 0.0005
BLOCK = 1 << 20


class Letters:
    """Which code points are letters, looked up by array."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[points]


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, block by block; runs of other signs count as one space.

    The last signs of a block are carried into the next, so no n-gram is lost or made at its edge.
    """
    spread = np.uint32(0x9E3779B1)
    carried = np.zeros(0, np.uint32)
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK].lower()
        part = (" " if at == 0 else "") + part + (" " if at + BLOCK >= len(text) else "")
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.concatenate([carried, np.where(Letters.of(points), points, np.uint32(32))])
        points = points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]
        old = len(carried)
        state = points * spread
        for n in range(2, max(SIZES) + 1):
            state = (state[:-1] ^ (state[:-1] >> np.uint32(15))) * spread + points[n - 1 :]
            if n in SIZES and len(state):
                # N-grams that end in the carried signs were given before.
                fresh = state[max(0, old - n + 1) :]
                grams = (fresh ^ (fresh >> np.uint32(13))) * np.uint32(0x85EBCA6B)
                yield (grams >> np.uint32(32 - 16)).astype(np.intp) % BUCKETS
        carried = points[-(max(SIZES) - 1) :]


def sampled_subwords(text: str, most: int) -> list[int]:
    """At most ``most`` of a text's buckets, evenly spread over the whole text."""
    blocks = list(subwords(text))
    if not blocks:
        return []
    grams = np.concatenate(blocks)
    step = -(-len(grams) // most)
    return grams[::step].tolist()


@dataclass
class LanguageModel:
    """Log-odds table and limits; ``reject`` is what the rows' scores are held against."""

    languages: list[str]
    table: np.ndarray = field(repr=False)
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    least_known: float = 0.0
    known: np.ndarray = field(default=None, repr=False)

    def logits(self, text: str) -> tuple[np.ndarray, float] | None:
        """Mean logits and the share of subwords met in training; None without a letter."""
        total, count, known = np.zeros(len(self.languages)), 0, 0
        for grams in subwords(text):
            total += self.table.take(grams, axis=0).sum(axis=0, dtype=np.float64)
            known += int(self.known.take(grams).sum())
            count += len(grams)
        return (total / count + self.bias, known / count) if count else None

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, calibrated score and whether the text is rejected."""
        found = self.logits(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0, True
        p = softmax(found[0][None] / self.temperature)[0]
        best = int(p.argmax())
        score = float(p[best])
        return self.languages[best], score, score < self.least_score or found[1] < self.least_known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, list[int]]], seed: int = 7) -> LanguageModel:
    """Fit on (language, buckets) rows; every fifth row only calibrates."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(0), known=np.zeros(1, bool))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(rows))
    labels = np.array([languages.index(lang) for lang, _ in rows])
    grams = [np.array(g) for _, g in rows]
    check = order[::5] if len(rows) >= 50 else order
    learn = np.delete(order, np.s_[::5]) if len(rows) >= 50 else order
    embed = draw.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = draw.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    share = np.bincount(labels[learn], minlength=len(languages)) / len(learn)
    balance = 1 / np.maximum(share * len(languages), 1e-3)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(learn)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(learn), BATCH):
            batch = learn[at : at + BATCH]
            sizes = np.array([len(grams[i]) for i in batch])
            flat = np.concatenate([grams[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            mean = np.add.reduceat(embed[flat], np.append(0, np.cumsum(sizes)[:-1]), axis=0)
            mean /= sizes[:, None]
            error = softmax(mean @ weight + bias)
            error[np.arange(len(batch)), labels[batch]] -= 1
            error *= balance[labels[batch], None] / len(batch)
            back = error @ weight.T
            weight -= rate * mean.T @ error
            bias -= 0.1 * rate * error.sum(axis=0)
            np.add.at(embed, flat, -rate * (back / sizes[:, None])[row])
        learn = draw.permutation(learn)
    known = np.zeros(BUCKETS, bool)
    known[np.concatenate([grams[i] for i in learn])] = True
    model = LanguageModel(languages, (embed @ weight).astype(np.float32), bias, known=known)
    calibrate(model, [grams[i] for i in check], labels[check])
    return model


def calibrate(model: LanguageModel, grams: list[np.ndarray], labels: np.ndarray) -> None:
    """Temperature of least log loss, then the limits that keep nearly all right rows."""
    logits = np.array([model.table[g].mean(axis=0, dtype=float) for g in grams]) + model.bias
    known = np.array([model.known[g].mean() for g in grams])
    place = np.arange(len(labels))
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(softmax(logits / t)[place, labels] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.argmax(axis=1) == labels
    if right.any():
        # Never above an even split among two: a text that leans to one language stays.
        model.least_score = float(min(0.5, np.quantile(p.max(axis=1)[right], MAX_LOST)))
        model.least_known = float(0.5 * np.quantile(known[right], MAX_LOST))


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    grams_per_row: int = GRAMS_PER_ROW,
) -> LanguageModel:
    """Learn from rows where ``learn`` holds and the language is known.

    The sample holds about ``rows_per_language`` rows of each language, chosen
    by a hash of the id and the text's length, and ``grams_per_row`` subwords of each: its size
    depends on the number of languages alone. Rows without a letter teach nothing.
    """
    names = {"doc_id": id_col, "text": text_col, "lang": lang_col}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in names.items()])
    rows = rows.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return train([])
    share = [(r["lang"], min(1.0, rows_per_language / r["count"])) for r in counts]
    spark = docs.sparkSession
    chance = F.broadcast(spark.createDataFrame(share, "lang string, share double"))
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            grams = [sampled_subwords(t, grams_per_row) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grams, pa.list_(pa.int32()))], ["lang", "grams"]
            )

    sample = (
        rows.join(chance, "lang")
        .where(draw < F.col("share"))
        .select("lang", "text")
        .mapInArrow(run, "lang string, grams array<int>")
        .where(F.size("grams") > 0)
        .collect()
    )
    return train(sorted((r["lang"], r["grams"]) for r in sample))


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row, from its whole text.

    Null texts and texts without a letter get ``und``, score 0 and are rejected,
    as is everything if the model has learned no language. Repeated rows and
    null ids are rows like others. Only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.string(), pa.float64(), pa.bool_()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for ids, texts in texts_of(slices(batches)):
            lang, score, rejected = zip(*map(shared.value.predict, texts)) if texts else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, (lang, score, rejected), kinds)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def known_only(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows that ``identify`` would not reject, with all their columns.

    Null texts and texts without a letter go; repeated rows and null ids are
    judged like others; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([not shared.value.predict(t or "")[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
