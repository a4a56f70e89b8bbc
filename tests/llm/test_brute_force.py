"""Classifiers against their formulas written out by hand, and very long texts."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.llm import fingerprints, language, lexical, quality, queries, secret_scan
from logvane.llm.common import is_held_out


def log_density(x, mean, spread):
    """Logarithm of a normal density by determinant and solved system, without its constant."""
    away = x - mean
    return -0.5 * away @ np.linalg.solve(spread, away) - 0.5 * math.log(np.linalg.det(spread))


def test_quality_scores_equal_shrunk_normal_densities(spark, testdata):
    docs = queries.documents(spark, testdata)
    known = queries.labels(spark, testdata).where(~is_held_out(F.col("doc_id")))
    features = quality.text_statistics(docs, "doc_id", "text")
    rows = {r["doc_id"]: np.array([r[s] for s in quality.STATISTICS]) for r in features.collect()}
    labels = [(r["doc_id"], r["quality"]) for r in known.collect() if r["quality"] in (0, 1)]
    groups = [np.array([rows[i] for i, q in labels if q == k and i in rows]) for k in (0, 1)]
    size, total = len(quality.STATISTICS), sum(map(len, groups))
    means = [g.mean(axis=0) for g in groups]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own)) / total
    unit = np.diag(1 / np.sqrt(np.maximum(np.diag(pooled), 1e-6)))
    spreads = []
    for group, cov in zip(groups, own):
        weight = quality.TO_POOLED + (1 - quality.TO_POOLED) * size / (size + len(group))
        shrunk = unit @ ((1 - weight) * cov + weight * pooled) @ unit
        shrunk = (1 - quality.TO_IDENTITY) * shrunk + quality.TO_IDENTITY * max(np.trace(shrunk) / size, 1e-3) * np.eye(size)
        spreads.append(shrunk)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, known).collect()}
    assert set(got) == set(rows)
    for i, x in rows.items():
        low, high = (
            math.log(len(g) / total) + log_density(unit @ x, unit @ m, s) for g, m, s in zip(groups, means, spreads)
        )
        want = 1 / (1 + math.exp(max(-60, min(60, low - high))))
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_language_scores_equal_a_mean_over_single_subwords(spark, testdata):
    docs = queries.documents(spark, testdata)
    model = language.fit(docs, ~is_held_out(F.col("doc_id")))

    def bucket(gram):
        """One n-gram's bucket in plain integers of 32 bits."""
        state, mask = ord(gram[0]) * 0x9E3779B1 & 0xFFFFFFFF, 0xFFFFFFFF
        for sign in gram[1:]:
            state = ((state ^ state >> 15) * 0x9E3779B1 + ord(sign)) & mask
        return ((state ^ state >> 13) * 0x85EBCA6B & mask) >> 16

    rows = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 60").collect()}
    got = {r["doc_id"]: r for r in language.identify(docs.where("doc_id < 60"), model).collect()}
    for i, text in rows.items():
        plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} "))
        grams = [plain[k : k + n] for n in language.SIZES for k in range(len(plain) - n + 1)]
        if not any(map(str.isalpha, plain)):
            assert got[i]["lang_pred"] == "und"
            continue
        logits = np.mean([model.table[bucket(g) % language.BUCKETS].astype(float) for g in grams], axis=0) + model.bias
        odds = np.exp((logits - logits.max()) / model.temperature)
        assert got[i]["lang_pred"] == model.languages[int(odds.argmax())]
        assert got[i]["score"] == pytest.approx(float(odds.max() / odds.sum()), abs=1e-5)


def test_blocks_of_a_text_lose_and_make_no_subword(monkeypatch):
    text = "Ein längeres Wort, 12 und  noch eins -- x" * 7
    whole = sorted(np.concatenate(list(language.subwords(text))).tolist())
    for block in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "BLOCK", block)
        assert sorted(np.concatenate(list(language.subwords(text))).tolist()) == whole
    assert not [g for g in language.subwords("12 -- 3") if len(g)]


# Longer than a slice of a batch may be, and than any text of the tables.
LONG = " ".join(f"word{i % 9973} and{i % 31}" for i in range(520_000))


def test_very_long_texts_are_read_to_their_end(spark):
    assert len(LONG.encode()) > 7 << 20
    docs = spark.createDataFrame([(1, LONG + " hidden token=abcdef123"), (2, LONG), (3, "word1 and1")], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()}
    assert spans == {1: f"assign:{len(LONG) + 8}:{len(LONG) + 23}", 2: "", 3: ""}
    items = spark.createDataFrame([(7, "hidden"), (8, "word9972")], "item_id long, text string")
    found = {(r["item_id"], r["doc_id"]) for r in lexical.search(lexical.forward(docs, items), items).collect()}
    assert found == {(7, 1), (8, 1), (8, 2)}
    near = {r["doc_id"]: r for r in fingerprints.edited_by_next(docs).collect()}
    assert near[1]["n_chars"] == len(LONG) + 23 and near[1]["near_next"] > 0.99
