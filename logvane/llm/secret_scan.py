"""Secrets in texts: fixed patterns, and runs that look random to character Markov models.

A first pass over all texts counts which sign follows which: inside what the
patterns found (labelled secrets) and everywhere else (ordinary words and
identifiers). These counts, a few thousand numbers, give two first-order Markov
chains; more chains come from strings drawn at random in the usual encodings of
keys. A second pass takes every long run of key signs that no pattern touches
and compares the chains: it is a secret when the mean likelihood under the
random chains exceeds that under the ordinary one by more than the prior odds.

Nothing is shuffled but the counts. A task holds one slice of texts, at least one text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import id_and_text, slices

# Fixed patterns. A match shorter than asked for is dropped, but its signs are used up.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_VALUE = 6
# A run of these signs is taken whole by the leftmost match, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Every assignment has one of these; most texts have none.
_KEYWORDS = ("pass", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

# Runs of key signs that the models look at, and the odds against one being a secret.
LEAST_RUN = 16
PRIOR_ODDS = 1e5
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)

_LOWER, _UPPER = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_SIGNS = _LOWER + _UPPER + _DIGITS + b"+/_=-"
# The state before the first sign of a run; also stands for every sign outside runs.
_OUT = len(_SIGNS)
_STATES = _OUT + 1
_CODE = np.full(256, _OUT, np.intp)
_CODE[np.frombuffer(_SIGNS, np.uint8)] = np.arange(_OUT)
_SMOOTH = 0.5

# Encodings of random strings, how many of each are drawn and how long they are.
_ENCODINGS = (
    _DIGITS + _LOWER[:6],
    _DIGITS + _UPPER[:6],
    _UPPER + b"234567",
    _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + b"+/",
    _UPPER + _LOWER + _DIGITS + b"-_",
)
DRAWN = 2000
DRAWN_LENGTH = 32

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, in order."""
    found: list[Span] = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    lower = text.lower()
    if any(map(lower.__contains__, _KEYWORDS)):
        found += [
            (m.start(), 0, m.end())
            for m in _ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= _ASSIGN_VALUE
        ]
    return sorted(found)


def free_runs(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Long runs of key signs that no span of ``spans`` touches."""
    out, at = [], 0
    ends = np.maximum.accumulate([s[2] for s in spans]) if spans else ()
    for m in _RUN.finditer(text):
        # Spans that start before the run ends; the furthest of their ends tells whether one touches.
        while at < len(spans) and spans[at][0] < m.end():
            at += 1
        if not at or ends[at - 1] <= m.start():
            out.append(m.span())
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _pairs(data: bytes) -> np.ndarray:
    """Counts of a sign (row) and the next one (column); text between runs is one state."""
    codes = _CODE[np.frombuffer(data, np.uint8)]
    before = np.concatenate([[_OUT], codes[:-1]]) if len(codes) else codes
    return np.bincount(before * _STATES + codes, minlength=_STATES * _STATES)


def _chain(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the next sign inside runs."""
    inside = counts.reshape(_STATES, _STATES)[:, :_OUT] + _SMOOTH
    return np.log(inside / inside.sum(axis=1, keepdims=True))


def _drawn(alphabet: bytes) -> bytes:
    """Random strings of an alphabet, parted by spaces; the same in every run."""
    out, n = [], len(alphabet)
    for i in range(DRAWN):
        raw = b"".join(
            hashlib.sha256(b"%d:%d:%d" % (n, i, k)).digest() for k in range(-(-DRAWN_LENGTH // 16))
        )
        # Two bytes a sign make every sign nearly equally likely.
        values = np.frombuffer(raw, "<u2")[:DRAWN_LENGTH] % n
        out.append(bytes(alphabet[v] for v in values))
    return b" ".join(out)


@dataclass(frozen=True)
class Model:
    """Log-probabilities of the chains: one of ordinary runs, several of random ones."""

    ordinary: np.ndarray
    random: np.ndarray

    def ratio(self, run: str) -> float:
        """How much likelier a run is under the random chains' mean than as an ordinary one, as a log."""
        codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
        before = np.concatenate([[_OUT], codes[:-1]])
        own = self.random[:, before, codes].sum(axis=1)
        top = own.max()
        mean = top + math.log(np.exp(own - top).mean())
        return float(mean - self.ordinary[before, codes].sum())

    def is_secret(self, run: str) -> bool:
        return self.ratio(run) > math.log(PRIOR_ODDS)


def model_of(ordinary: np.ndarray, secret: np.ndarray) -> Model:
    """Chains from the counts of ordinary signs and of signs inside labelled secrets."""
    chains = [_chain(_pairs(_drawn(alphabet))) for alphabet in _ENCODINGS]
    if secret.any():
        chains.append(_chain(secret))
    # A span begins in the state outside, which the text need not have been in: a count may fall below 0.
    return Model(_chain(np.maximum(ordinary, 0)), np.array(chains))


def count_pairs(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sign pairs outside and inside the patterns' spans."""
    outside = np.zeros(_STATES * _STATES, np.int64)
    inside = outside.copy()
    for text in texts:
        spans = base_spans(text)
        whole = _pairs(text.encode("utf-8", "surrogatepass"))
        if spans:
            # Spans that overlap count once, as one.
            merged: list[list[int]] = []
            for start, _, end in spans:
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            for start, end in merged:
                whole -= _pairs(text[start:end].encode())
            values = [v for start, end in merged for v in _RUN.findall(text[start:end])]
            inside += _pairs(" ".join(values).encode())
        outside += whole
    return outside, inside


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Chains from all texts. Null texts count as empty; without any text only the drawn strings teach.

    Only sums of counts reach the driver: one number for each pair of signs, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * _STATES * _STATES, np.int64)
        for batch in slices(batches):
            total += np.concatenate(count_pairs(t or "" for t in batch.column(0).to_pylist()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    texts = id_and_text(docs, id_col, text_col).select("text")
    cells = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(2 * _STATES * _STATES)
    for row in cells.collect():
        total[row["cell"]] = row["n"]
    return model_of(*np.split(total, 2))


def spans_of(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans in order of start and kind."""
    base = base_spans(text)
    random = [
        (start, 3, end) for start, end in free_runs(text, base) if model.is_secret(text[start:end])
    ]
    return base, sorted(base + random)


def scan(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row.

    ``spans`` lists kind:start:end in code points, end exclusive; the digest is
    of the patterns' own. Null texts count as empty: no spans, and the digest of
    nothing. Repeated rows come back each by itself; an empty table gives an
    empty result; other columns are ignored. Texts of any length are read whole.
    """
    rows = id_and_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            counts, digests, listed = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text or "", known)
                counts.append(np.bincount([s[1] for s in every], minlength=len(KINDS)))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                listed.append(joined(every))
            columns = np.array(counts, np.int64).reshape(-1, len(KINDS)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns), pa.array(digests), pa.array(listed)], names
            )

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {key}, n_assign long, n_access long, n_hex long, n_random long, "
        "base_sha256 string, spans string",
    )


def redact(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with all their columns, each secret in the text replaced by its kind in brackets.

    Spans that overlap are replaced as one, under the first one's kind. Null texts stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def clean(text: str | None, known: Model) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for start, kind, end in spans_of(text, known)[1]:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [clean(t, shared.value) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
