"""Wide rows: rounding without decimal objects, methods that Java compiles."""

import math

import numpy as np
from pyspark.sql import functions as F

from logvane.functions.coerce import rounded
from logvane.session import METHOD_LIMIT_CONF


def test_rounded_is_round(spark):
    rng = np.random.default_rng(9)
    odd = [0.0, -0.0, -1e-9, 1.000005, -1.000005, 2.5e-6, 0.123455, 1e9, -4e12, 9.99999500001, 1e300, 5e-324]
    odd += [math.nan, math.inf, -math.inf, None]
    odd += [float(x) for x in rng.integers(-(10**7), 10**7, 2000) / 1e6] + [float(x) for x in rng.normal(size=2000)]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    texts = df.select(*[c.cast("string") for k in (0, 3, 5, 9) for c in (F.round("x", k), rounded(F.col("x"), k))])
    for row in texts.collect():
        assert row[0::2] == row[1::2]


def test_generated_methods_stay_small_enough_to_be_compiled(spark, testdata):
    import __spark_entry__ as contract

    name, limit = METHOD_LIMIT_CONF
    spark.conf.unset(name)
    contract.queries()["label_distribution"](spark, testdata)
    assert int(spark.conf.get(name)) == int(limit) <= 8000
