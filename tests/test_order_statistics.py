import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logvane.operators import quantiles
from logvane.operators.ordering import running_sums, trailing_mean, with_positions
from logvane.operators.quantiles import exact_quantiles, order_statistics


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=1, max_size=60
    ),
    st.floats(0, 1),
)
def test_quantile_equals_numpy_even_when_every_range_is_divided(spark, values, probability):
    df = frame(spark, values)
    ordered = sorted(float(v) for v in values)
    rank = int(round(probability * (len(values) - 1)))
    assert order_statistics(df, {"v": [rank]}, ranked_rows=1)["v", rank] == ordered[rank]


@pytest.mark.parametrize("ranked_rows", [1, 50, 200_000])
def test_skewed_tied_and_heavy_tailed_columns(spark, ranked_rows):
    rng = np.random.default_rng(3)
    data = {
        "tied": np.where(rng.random(6000) < 0.34, 7.0, rng.normal(size=6000)),
        "tails": np.exp(rng.normal(size=6000) * 20),
        "signed": rng.normal(size=6000) * 1e-9,
        "constant": np.full(6000, 3.5),
        "whole": rng.integers(0, 5, 6000).astype(float),
    }
    df = spark.createDataFrame(
        [tuple(float(x) for x in row) for row in zip(*data.values())],
        ", ".join(f"{c} double" for c in data),
    )
    for probability in (0.0, 0.01, 0.5, 0.77, 1.0):
        got = exact_quantiles(df, list(data), probability, ranked_rows=ranked_rows)
        for name, values in data.items():
            assert got[name] == pytest.approx(np.quantile(values, probability), rel=1e-12), name


@pytest.mark.parametrize("ranked_rows", [1, 20, 1000])
def test_a_sample_decides_the_brackets_but_not_the_values(spark, monkeypatch, ranked_rows):
    rng = np.random.default_rng(8)
    values = np.round(rng.normal(size=20_000), 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(values, values**3)], "a double, b double")
    sizes, narrowed = [], quantiles._narrowed

    def spied(frame, spans):
        sizes.append((copy := narrowed(frame, spans)).count())
        return copy

    monkeypatch.setattr(quantiles, "_narrowed", spied)
    for rank in (0, 199, 10_000, 19_999):
        got = order_statistics(df, {"a": [rank], "b": [rank]}, ranked_rows=ranked_rows, sketched_rows=2000)
        assert got["a", rank] == np.sort(values)[rank]
        assert got["b", rank] == np.sort(values**3)[rank]
    # What is looked at again is the rows in the brackets, not the table.
    assert sizes and max(sizes) < 6000


def test_nulls_are_ignored_and_bad_ranks_refused(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert exact_quantiles(df, ["v"], 0.5) == {"v": 2.0}
    with pytest.raises(ValueError):
        order_statistics(df, {"v": [2]})


def skewed_log(spark, rows=3000):
    """One source holds most rows; others are short."""
    rng = np.random.default_rng(5)
    data = [
        ("hot" if rng.random() < 0.7 else f"s{rng.integers(0, 40)}", int(t), int(w))
        for t, w in zip(rng.permutation(rows), rng.integers(0, 100, rows))
    ]
    return spark.createDataFrame(data, "source string, at bigint, w bigint"), data


def test_running_sums_and_positions(spark):
    df, data = skewed_log(spark)
    got = {r["at"]: r["total"] for r in running_sums(df, [F.col("at")], {"total": F.col("w")}).collect()}
    expected, total = {}, 0
    for _, at, w in sorted(data, key=lambda r: r[1]):
        total += w
        expected[at] = total
    assert got == expected
    placed = with_positions(df, [F.col("source"), F.col("at")]).collect()
    order = sorted(data, key=lambda r: (r[0], r[1]))
    assert {(r["source"], r["at"]): r["position"] for r in placed} == {
        (s, at): i for i, (s, at, _) in enumerate(order)
    }


@pytest.mark.parametrize("by", [(), ("source",)])
@pytest.mark.parametrize("chunk_rows", [40, 97, 50_000])
def test_trailing_mean_crosses_chunks(spark, by, chunk_rows):
    df, data = skewed_log(spark)
    got = trailing_mean(df, F.col("w"), 40, [F.col("at")], by, "m", chunk_rows).collect()
    assert len(got) == len(data)
    history, expected = {}, {}
    for source, at, w in sorted(data, key=lambda r: r[1]):
        seen = history.setdefault(source if by else None, [])
        seen.append(w)
        expected[at] = sum(seen[-40:]) / len(seen[-40:])
    for row in got:
        assert row["m"] == pytest.approx(expected[row["at"]])
