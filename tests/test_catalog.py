"""Every catalog query against its SQL on DuckDB, and the driver contract."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as contract


@pytest.fixture(scope="module")
def duck(testdata):
    return connect(testdata)


def test_contract_keys():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.ORACLE))
def test_query_equals_sql(spark, testdata, duck, name):
    difference, _ = differences(spark, duck, contract.queries()[name], contract.ORACLE[name], testdata)
    assert difference == ""


def test_queries_without_sql_cover_every_row(spark, testdata):
    flows = spark.read.parquet(f"{testdata}/lineitem.parquet").count()
    scored = contract.entry(spark)
    assert scored.count() == flows
    metrics = contract.queries()["training_metrics"](spark, testdata).first()
    assert metrics["fpr"] <= 0.05
    assert metrics["tp"] + metrics["fn"] > 0
