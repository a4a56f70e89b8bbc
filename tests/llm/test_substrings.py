"""Suffix arrays against sorting, removed substrings against a dictionary of all of them."""

import hashlib
import random

import pyarrow as pa
import pytest

from logvane.llm import queries, substrings
from logvane.llm.suffix_array import suffix_array


def test_suffix_array_equals_sorting():
    draw = random.Random(4)
    for _ in range(1500):
        top = draw.choice([0, 1, 2, 8])
        text = [draw.randint(0, top) for _ in range(draw.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def by_hand(rows, length):
    """rows: (doc_id, text), null ids last."""
    order = lambda r: (r[0] is None, r[0] or 0)
    first, out = {}, []
    for key, text in sorted(rows, key=order):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            first.setdefault(data[i : i + length], (key is None, key or 0))
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (key is None, key or 0):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out.append((key, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got_from(frame):
    return sorted(
        (
            (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
            for r in frame.collect()
        ),
        key=str,
    )


def test_op8_equals_dictionary(spark, testdata):
    for size in ("sf0.001", "sf0.01"):
        folder = testdata.replace("sf0.001", size)
        rows = [(r["doc_id"], r["text"]) for r in queries.documents(spark, folder).collect()]
        columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        got = queries.op8_substrings(spark, folder).select(columns).collect()
        assert sorted(map(tuple, got), key=str) == by_hand(rows, 50)


def planted(draw):
    letters = "ab é"
    passages = ["".join(draw.choice(letters + "cdefgh") for _ in range(draw.randint(30, 120))) for _ in range(6)]
    rows = []
    for key in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            parts.append("".join(draw.choice(letters + "ijklm") for _ in range(draw.randint(0, 60))))
            passage = draw.choice(passages)
            a, b = sorted(draw.randint(0, len(passage)) for _ in range(2))
            parts.append(draw.choice([passage, passage, passage[a:b]]))
        rows.append((key * 3 % 61, "".join(parts)))
    rows += [(200, "x" * 300), (201, "x" * 120 + "y"), (202, "ab" * 100), (203, "ba" * 60), (204, "x" * 49)]
    rows += [(300, None), (301, ""), (None, rows[3][1]), rows[5], rows[6], (rows[7][0], rows[8][1]), (305, rows[9][1])]
    return rows


@pytest.mark.parametrize("split", [4096, 3])
def test_planted_passages(spark, monkeypatch, split):
    monkeypatch.setattr(substrings, "BUCKET", 40)
    for seed in (1, 2):
        rows = planted(random.Random(seed))
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, doc long, version long")
        docs = docs.repartition(5)
        for anchor in (20, 45):
            got = got_from(substrings.remove_repeats(docs, 50, anchor, split=split))
            assert got == by_hand(rows, 50)


def test_nothing_to_do(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string")
    assert got_from(substrings.remove_repeats(docs)) == by_hand([(1, "a"), (2, None)], 50)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, 20, 30)


def test_contexts_equal_as_far_as_shared_are_not_sorted(monkeypatch):
    """200 documents share the 10 bytes before an anchor and all after it: one stays to be sorted, with nothing."""
    draw = random.Random(8)
    shared = draw.randbytes(40)
    n = 200
    columns = {
        "h": pa.array([7] * n, pa.int64()),
        "parts": pa.array([1] * n, pa.int32()),
        "doc": pa.array(range(n, 0, -1), pa.int64()),
        "version": pa.array([0] * n, pa.int64()),
        "places": pa.array([[30, 400 + i] for i in range(n)], pa.list_(pa.int32())),
        "left": pa.array([draw.randbytes(19) + bytes([i]) + shared[:10] for i in range(n)], pa.binary()),
        "right": pa.array([shared[10:]] * n, pa.binary()),
    }
    lengths = []
    sort = suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda text: lengths.append(len(text)) or sort(text))
    found = substrings._by_suffix_array(pa.table(columns), 50, 20).to_pylist()
    assert sum(lengths) < 100
    want = {(n - i, q - 10, q + 50) for i in range(n - 1) for q in (30, 400 + i)}
    assert {(r["doc"], r["lo"], r["hi"]) for r in found} == want and len(found) == len(want)


def test_strings_of_a_common_phrase_are_not_left_open(spark, monkeypatch):
    """A phrase shorter than what is removed, in so many documents that its anchor is dealt out."""
    draw = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    some = lambda n: "".join(draw.choice(letters) for _ in range(n))
    phrase, passage = some(40), some(90)
    rows = [(i, some(60) + phrase + some(60)) for i in range(300)]
    rows += [(300 + i, some(60) + passage + some(60)) for i in range(40)]
    written, write = [], substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df: written.append(write(df)) or written[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_from(substrings.remove_repeats(docs, split=16)) == by_hand(rows, 50)
    (still,) = [f.where("turn >= 0").count() for f in written if "turn" in f.columns]
    assert still < 2000
