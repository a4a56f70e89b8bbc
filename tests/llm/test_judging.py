"""Quality scores, quality rules, host reputation and language identification."""

import math
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from logvane.llm import language, quality, queries, reputation, rules
from logvane.llm.common import is_held_out

TEXTS = [
    None,
    "",
    " \n ",
    "one two",
    "the same eight words stand here once again " * 4,
    "a line of words\nanother line\na line of words\n\n",
    "ÀÉ !! ## $$ | é\x0bè\x0c<x>",
    "w " * 40_000,
    "plain words and more plain words follow here so that this text is long enough to be kept. " * 1,
]
SCHEMA = "doc_id long, text string, words string, score double, kept string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i else None, t, "x", 1.0, "y", "en" if i % 2 else None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[3:5], SCHEMA)


def counts_by_hand(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.strip("\x20\t\n\v\f\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_rule_counts(odd, spark, testdata):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = odd.select("doc_id", "text").union(
        spark.read.parquet(f"{testdata}/documents.parquet").select("doc_id", "text")
    )
    texts = Counter(counts_by_hand(r["text"]) for r in docs.collect())
    got = Counter(tuple(r) for r in rules.judge(docs).select(names).collect())
    assert got == texts


def test_rules_keep_clean_and_drop_junk(spark, testdata):
    judged = queries.op3_rules(spark, testdata).join(queries.labels(spark, testdata), "doc_id")
    fair = judged.where("not base_failed")
    assert fair.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.98
    assert judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.1


def test_rules_on_odd_rows(odd):
    got = rules.judge(odd).collect()
    assert len(got) == len(TEXTS) + 2
    assert all(r["kept"] is not None and 0 <= r["posterior"] <= 1 for r in got)
    assert rules.judge(odd.limit(0)).count() == 0


def test_estimate_finds_planted_accuracies():
    draw, names = random.Random(1), [f"r{i}" for i in range(6)]
    votes = Counter()
    for _ in range(20_000):
        good = draw.random() < 0.8
        votes[
            tuple(
                0 if draw.random() < 0.2 else (1 if draw.random() < (0.999 if good else 0.5) else -1)
                for _ in names
            )
        ] += 1
    share, right = rules.estimate(sorted(votes.items()), names)
    assert abs(share - 0.8) < 0.04
    assert all(abs(right[n][1] - 0.45) < 0.1 and right[n][0] > 0.99 for n in names)
    assert rules.estimate([], names)[0] == rules.PRIOR_GOOD


def test_quality_on_held_out_rows(spark, testdata):
    big = testdata.replace("sf0.001", "sf0.01")
    got = queries.op1_quality(spark, big).join(queries.labels(spark, big), "doc_id")
    held = got.where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in held)


def test_quality_on_odd_rows(odd, spark):
    labels = spark.createDataFrame(
        [(3, 1, 0), (3, 1, 0), (4, 0, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)],
        "doc_id long, quality int, score int",
    )
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(TEXTS) + 2
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    one_class = quality.classify(odd, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one_class} == {0.5}
    assert quality.classify(odd.limit(0), labels).count() == 0


URLS = [
    (1, "http://Sub.Example.NET/en/1?x#y"),
    (2, "https://a.example.net/de/1"),
    (3, "http://example.net"),
    (4, "http://x.org/fr/"),
    (5, "http://x.org?fr/"),
    (6, "no scheme/here"),
    (7, None),
    (7, "http://bad.example.org/1"),
    (8, "http://bad.example.org/1"),
    (9, "a://b://c/d"),
    (10, "://"),
    (11, "http://notexample.com/de/1"),
    (12, "http://example.com/de/1"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(*u, "h") for u in URLS], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(1, 0), (7, 1), (99, 1)], "doc_id long, bad int")
    got = reputation.judge(pages, outcomes, queries.URL_RULES)
    rows = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert rows == {
        (1, "sub.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "a.example.net", "/de/1", "net/", "block"),
        (3, "example.net", "", None, "allow"),
        (4, "x.org", "/fr/", "org/fr/", "allow"),
        (5, "x.org", "", None, "allow"),
        (6, "", "", None, "allow"),
        (7, "", "", None, "allow"),
        (7, "bad.example.org", "/1", None, "allow"),
        (8, "bad.example.org", "/1", None, "allow"),
        (9, "b:", "//c/d", None, "allow"),
        (10, "", "", None, "allow"),
        (11, "notexample.com", "/de/1", None, "allow"),
        (12, "example.com", "/de/1", "example.com/de/", "block"),
    }
    assert reputation.judge(pages.limit(0), outcomes, queries.URL_RULES).count() == 0
    assert reputation.judge(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 0


def test_bad_host_is_blocked_and_a_small_one_is_not(spark):
    hosts = [("spam.example.com", 300, 290), ("good.example.com", 3000, 60), ("new.example.com", 1, 1)]
    rows = [(h, int(i < bad)) for h, n, bad in hosts for i in range(n)]
    marks = spark.createDataFrame(rows, "host string, bad int")
    got = {r["host"]: r for r in reputation.host_reputation(marks).collect()}
    assert got["spam.example.com"]["lower"] > 0.9
    assert got["good.example.com"]["upper"] < 0.05
    assert got["new.example.com"]["lower"] < 0.5 and got["new.example.com"]["rate"] < 1


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_reputation_equals_sql(spark, testdata, size):
    folder = testdata.replace("sf0.001", size)
    duck = duckdb.connect()
    for table in ("pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = {tuple(r) for r in queries.op6_reputation(spark, folder).select(columns).collect()}
    want = duck.execute(queries.ORACLE["op6_reputation"])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert got == {tuple(r[i] for i in order) for r in want.fetchall()}


def test_language_on_held_out_rows(spark, testdata):
    big = testdata.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    got = queries.op7_language(spark, big).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert got.count() == docs.count()


def test_language_rejects_what_it_cannot_know(odd, spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    model = language.fit(docs, ~is_held_out(F.col("doc_id")))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "漢字仮名交じり文"), (5, "the words of the"), (5, "é")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    by_id = {r["doc_id"]: r for r in got[:5]}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["rejected"] for i in (1, 2, 3))
    assert by_id[4]["rejected"] and not by_id[5]["rejected"] and by_id[5]["lang_pred"] == "en"
    clean = language.identify(docs, model)
    assert clean.where("rejected").count() <= 0.01 * docs.count()
    assert language.identify(odd, model).count() == len(TEXTS) + 2
    assert language.identify(odd.limit(0), model).count() == 0
    empty = language.fit(odd.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    few = language.fit(odd, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd, few).collect()} <= {"und", "en"}
