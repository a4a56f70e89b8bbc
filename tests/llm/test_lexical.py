"""Ranked search against scoring every document, and its blocks against what they bound."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from logvane.llm import lexical

SCHEMA = "doc_id long, text string, block string, n string, terms string"
WORDS = [f"w{i}" for i in range(60)] + ["été", "漢字", "x1", "The", "the"]


def texts(n=400, seed=3):
    draw = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    made = [
        " ".join(draw.choices(WORDS, weights, k=draw.choice([1, 5, 30, 200])))
        + draw.choice(["", ".", "-THE_", " a.b"])
        for _ in range(n)
    ]
    long = " ".join(draw.choices(WORDS, k=150_000))
    return [None, "", " .,", long, *made, *made[:20]]


def brute(docs, items, k=10):
    """Every document's score for every item by the definition; null ids last."""
    import re

    def terms(t):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    merged = {}
    for item, t in items:
        merged.setdefault(item, set()).update(terms(t))
    out = []
    for item, asked in merged.items():
        rows = []
        for i, c, n in found:
            m = 10 + 90 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in asked & c.keys()
            )
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, r, row[3], -row[0]) for r, row in enumerate(sorted(rows)[:k], 1)]
    return out


def test_query_equals_scoring_all(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 50)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    rows = [(None if i == 7 else i // 2 if i > 420 else i, t) for i, t in enumerate(texts())]
    items = [(i, " ".join(random.Random(i).sample(WORDS, 8))) for i in range(30)]
    items += [(3, "w5 again"), (40, None), (41, "absent"), (42, "w0 w1 w2 w3 w4 w5"), (43, "W1, w1 w1")]
    docs = spark.createDataFrame([(i, t, "b", "n", "t") for i, t in rows], SCHEMA).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    key = lambda r: (r[0], r[1])
    for query_bytes in (1 << 20, 150):  # one block of queries, several
        monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)
        got = [tuple(r) for r in lexical.search(lexical.forward(docs, asked), asked).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(lexical.forward(docs, asked), asked).collect() == []
    some = spark.createDataFrame([(1, "a b", "", "", "")], SCHEMA)
    assert lexical.search(lexical.forward(some, asked.limit(0)), asked.limit(0)).collect() == []


@pytest.fixture
def segment():
    draw = np.random.default_rng(5)
    # Two kinds of documents: similar ones share their terms.
    terms = [np.sort(draw.choice(40, 12, replace=False)) + 40 * (i % 2) for i in range(300)]
    impacts = [draw.integers(1, 900_000, 12) for _ in terms]
    return lexical.Segment(list(range(300)), terms, impacts)


def test_blocks_bound_their_documents(segment):
    docs, starts, summary = segment.docs, segment.starts, segment.summary
    for t in range(len(segment.terms)):
        blocks = range(segment.first[t], segment.first[t + 1])
        own = np.concatenate([docs[starts[b] : starts[b + 1]] for b in blocks])
        assert sorted(own) == np.flatnonzero(segment.impact[:, t]).tolist()
    for b in range(len(summary)):
        own = docs[starts[b] : starts[b + 1]]
        assert (summary[b].astype(int) * lexical.STEP >= segment.impact[own].max(axis=0)).all()


def test_clusters_keep_similar_documents_together(segment):
    near = segment._projected()
    clusters = segment._clusters(np.arange(300), near)
    assert len(clusters) > 1
    # The share of each cluster's commoner kind; clusters at random would have little over one half.
    pure = sum(max(np.sum(c % 2), np.sum(c % 2 == 0)) for c in clusters) / 300
    assert pure > 0.8


def test_blocks_are_skipped(monkeypatch):
    """Documents far below the best ones are never scored, and the result is the same."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 8)
    draw = np.random.default_rng(1)
    terms = [np.array([0, 1 + i % 8], np.int32) for i in range(800)]
    impacts = [draw.integers(1, 90_000, 2) * (10 if i % 8 == 0 else 1) for i in range(800)]
    made = lexical.Segment(list(range(800)), terms, impacts)
    best = lexical.Best(5)
    skipped = lexical.search_segment(made, np.array([0, 1], np.int32), np.array([10, 3]), best)
    score = made.impact[:, 0].astype(int) * 10 + made.impact[:, 1].astype(int) * 3
    assert sorted(s for s, _, _ in best.rows) == sorted(score)[-5:]
    assert skipped > 20
