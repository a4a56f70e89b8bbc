"""The pipeline's stages on planted rows and over a whole small table."""

from collections import defaultdict

import pytest
from test_jaccard import by_hand as components_by_hand

import corpus_pipeline
from logvane.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def stages(spark, testdata, tmp_path_factory):
    """Each stage's documents, as Parquet between the stages."""
    docs = queries.documents(spark, testdata)
    folder, out = tmp_path_factory.mktemp("stages"), {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, testdata).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns_and_rows(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = stages["documents"]
    for name in names[:-1]:
        after = stages[name]
        assert after.columns == before.columns
        assert after.schema == before.schema
        rows = after.collect()
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()}
        assert all(r["n_chars"] == len(r["text"]) and r["text"].strip() for r in rows)
        before = after
    assert stages["language_id"].count() >= 0.98 * stages["documents"].count()


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["line_dedup"].collect()]

    def shingles(text, size=5):
        words = text.encode().lower().split()
        n = max(len(words) - size + 1, 1)
        return frozenset(tuple(words[i : i + size]) for i in range(n)) if words else frozenset()

    import test_jaccard

    four, test_jaccard.shingles = test_jaccard.shingles, shingles
    try:
        want = {c for _, _, c in components_by_hand(rows, 80)}
    finally:
        test_jaccard.shingles = four
    assert set(texts(stages["ngram_jaccard"])) == want


def test_no_string_of_fifty_bytes_is_left_twice(stages):
    before = texts(stages["ngram_jaccard"])
    first = {}
    for key in sorted(before):
        data = before[key].encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], key)
    after = texts(stages["suffix_dedup"])
    for key, text in before.items():
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
        assert after.get(key, "").strip() == left.strip()


def test_pieces_cover_every_document(stages):
    found = defaultdict(list)
    for r in stages["packing"].collect():
        assert len(r["ids"]) == r["length"]
        found[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert set(found) == set(texts(stages["suffix_dedup"]))
    for pieces in found.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at
            at += length
        assert at == total


def test_odd_rows_go_through(spark, testdata):
    docs = queries.documents(spark, testdata).limit(60).selectExpr("*", "'x' as extra")
    odd = [
        (None, "the words of the man that is in it for this", None, None, None, None),
        (901, None, "en", "s", 0, "y"),
        (902, "", "en", "s", 0, "y"),
        (903, "12 34 !!", "de", "s", 8, "y"),
        (904, "漢字仮名交じり文", None, "s", 8, "y"),
        (905, "word " * 30_000, "en", "s", 150_000, "y"),
        (905, "word " * 30_000, "en", "s", 150_000, "y"),
        (905, "other words that the man is of", "en", "s", 150_000, "y"),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, testdata).cache()
        left = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            assert not left & {901, 902, 903, 904} and 905 in left
        if name == "ngram_jaccard":
            assert docs.count() == docs.distinct().count()
    empty = queries.documents(spark, testdata).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, testdata)
        assert empty.count() == 0
