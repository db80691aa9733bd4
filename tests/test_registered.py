"""Every registered check against its SQL twin, and what its plan must not hold."""

import pytest

import __spark_entry__ as contract
from plumbline.plans.checks import checks
from plumbline.plans.oracles import oracles
from tests.oracle import connect, spark_rows, sql_rows, sql_types

QUERIES = checks()
ORACLES = oracles()

SQL_NAMES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
}

# One row meets all rows, or rows leave the JVM.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "ExistingRDD[obj"]


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_check_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result_as_sql(spark, folder, connection, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in UNWANTED if bad in plan]

    names, rows = spark_rows(df)
    sql_names, expected = sql_rows(connection, ORACLES[name])
    assert names == sql_names
    assert rows == expected
    assert rows

    types = {n: SQL_NAMES[t] for n, t in df.dtypes}
    assert types == sql_types(connection, ORACLES[name])


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 11
