import hashlib

import pytest
from pyspark.sql import functions as F

from logvane.operators import sampling


def digest(row_id, seed=42):
    return hashlib.md5(f"{seed}|{row_id}".encode()).hexdigest()


@pytest.fixture(scope="module")
def flows(spark):
    """One label holds most rows; some are rare or blank."""
    rows = []
    for i in range(9000):
        label = " BENIGN" if i % 10 < 7 else "DDoS" if i % 10 < 9 else "Bot "
        rows.append((f"r{i}", "a.csv" if i % 3 else "b.csv", label))
    rows += [(f"h{i}", "a.csv", "Heartbleed") for i in range(11)]
    rows += [(f"e{i}", "b.csv", "  ") for i in range(400)]
    return spark.createDataFrame(rows, "id string, file string, Label string"), rows


def expected_sample(rows):
    strata = {}
    for row_id, file, label in rows:
        strata.setdefault((file, label.strip()), []).append(row_id)
    kept = set()
    for (_, label), ids in strata.items():
        fraction = 0.02 if label == "BENIGN" else max(0.02, min(1.0, 300 / len(ids)))
        kept |= set(sorted(ids, key=digest)[: round(fraction * len(ids))])
    return kept


@pytest.mark.parametrize("ranked_rows", [3, 100, 1_000_000])
def test_exact_sample_equals_brute_force_at_any_depth(flows, ranked_rows):
    df, rows = flows
    drawn = sampling.stratified_sample(df, ["id"], ranked_rows=ranked_rows)
    assert drawn.columns == df.columns
    assert {r["id"] for r in drawn.collect()} == expected_sample(rows)


def test_sample_is_stable_under_repartitioning(flows):
    df, rows = flows
    drawn = sampling.stratified_sample(df.repartition(13), ["id"])
    assert {r["id"] for r in drawn.collect()} == expected_sample(rows)


def test_sample_keeps_labels_as_they_came(flows):
    df, _ = flows
    labels = {r["Label"] for r in sampling.stratified_sample(df, ["id"]).collect()}
    assert labels == {" BENIGN", "DDoS", "Bot ", "Heartbleed", "  "}


def test_bernoulli_sample_is_close_to_the_fractions(flows):
    df, rows = flows
    drawn = sampling.stratified_sample(df, ["id"], exact=False)
    counts = {r["Label"]: r["count"] for r in drawn.groupBy("Label").count().collect()}
    assert counts["Heartbleed"] == 11
    assert abs(counts["DDoS"] - 600) < 120


def test_split_is_disjoint_complete_and_stable(flows):
    df, _ = flows
    benign, attack = sampling.split_benign(df)
    train, test = sampling.train_test_split(benign, ["id"])
    counts = [x.count() for x in (train, test, attack)]
    assert sum(counts) == df.count() and abs(counts[0] / sum(counts[:2]) - 0.8) < 0.02
    again, _ = sampling.train_test_split(benign.repartition(7), ["id"])
    assert again.exceptAll(train).count() == 0


def test_replay_order_is_seeded(flows):
    df, rows = flows
    first = [r["id"] for r in sampling.replay_order(df, ["id"], 50).collect()]
    assert first == sorted((r[0] for r in rows), key=digest)[:50]
    assert sampling.replay_order(df, ["id"], 0).count() == len(rows)
    other = [r["id"] for r in sampling.replay_order(df, ["id"], 50, seed=1).collect()]
    assert other != first


def test_fractions(spark):
    df = spark.createDataFrame(
        [("BENIGN", 100), ("x", 11), ("x", 600), ("x", 100_000)], "label string, n bigint"
    )
    got = [r[0] for r in df.select(sampling.sampling_fraction(F.col("label"), F.col("n"))).collect()]
    assert got == [0.02, 1.0, 0.5, 0.02]


def test_null_strata_keep_their_rows(spark):
    rows = [(i, "f" if i % 2 else None, "BENIGN" if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "row long, file string, Label string")
    for exact in (True, False):
        got = sampling.stratified_sample(df, ["row"], exact=exact)
        kept = {(r["file"], r["Label"]) for r in got.collect()}
        assert (None, None) in kept and ("f", None) in kept
    whole = sampling.stratified_sample(df.where("Label is null"), ["row"])
    assert whole.count() == df.where("Label is null").count()


def test_ids_that_do_not_tell_rows_apart_are_refused(spark):
    df = spark.range(3000).selectExpr("1 as row", "'f' as file", "'BENIGN' as Label")
    with pytest.raises(ValueError, match="tell rows apart"):
        sampling.stratified_sample(df, ["row"], ranked_rows=100)
