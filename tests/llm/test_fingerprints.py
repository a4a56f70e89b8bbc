"""Fingerprints against sets of shingles built by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logvane.llm import fingerprints as fp
from logvane.llm import queries


def shingles(text):
    words = text.split()
    n = max(len(words) - 4, 1) if words else 0
    return {tuple(words[i : i + 5]) for i in range(n)}


def test_op5_on_real_documents(spark, testdata):
    docs = {r["doc_id"]: r["text"] for r in queries.documents(spark, testdata).collect()}
    order = sorted(docs)
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, testdata).collect()}
    assert sorted(got) == order
    close, far = [], []
    for i, key in enumerate(order):
        text, after, r = docs[key], docs[order[(i + 1) % len(order)]], got[key]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        close.append(r["near_edited"] - len(a & b) / len(a | b))
        far.append(abs(r["near_next"] - (1.0 if text == after else len(a & c) / len(a | c))))
    assert abs(sum(close) / len(close)) < 0.05
    assert sum(map(abs, close)) / len(close) < 0.15
    assert sum(far) / len(far) < 0.05
    by_text = {}
    for key in order:
        assert by_text.setdefault(docs[key], got[key]["fingerprint"]) == got[key]["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def test_whole_fraction_is_exact_and_merges(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(draw.choice(words) for _ in range(3000))
    short = " ".join(long.split()[500:600])
    rows = spark.createDataFrame([(short, long)], "a string, b string")
    rows = fp.with_sketch(fp.with_sketch(rows, "a", "x", 1.0), "b", "y", 1.0)
    rows = fp.with_sketch(rows, "b", "z", 1 / 8)
    a, b = F.col("x"), F.col("y")
    r = rows.select(
        F.size(a), F.size(b), fp.likeness(a, b), fp.containment(a, b), fp.merge(a, b) == b, F.size("z")
    ).first()
    sa, sb = shingles(short), shingles(long)
    assert tuple(r)[:5] == (len(sa), len(sb), len(sa & sb) / len(sa | sb), 1.0, True)
    assert abs(r[5] - len(sb) / 8) < 80
    with pytest.raises(ValueError):
        fp.with_sketch(rows, "a", "q", 0)


def test_odd_rows(spark):
    rows = [(None, "n u l l"), (3, None), (3, None), (1, ""), (2, "a b"), (2, "a c"), (9, "ß é 漢字 x" * 3)]
    docs = spark.createDataFrame([(*r, "k", "e") for r in rows], "doc_id long, text string, key string, edited string")
    got = fp.edited_by_next(docs).collect()
    assert len(got) == len(rows)
    assert len({tuple(r) for r in got if r["doc_id"] == 3}) == 1
    last = next(r for r in got if r["doc_id"] == 9)
    text = rows[-1][1]
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + "n u l l"[:quarter]
    assert last["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fp.edited_by_next(docs.limit(0)).count() == 0
    one = fp.edited_by_next(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0
    assert fp.fingerprints(docs).count() == len(rows)
