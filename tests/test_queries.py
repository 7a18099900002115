import pytest

import __spark_entry__ as entry_module
from check import connect, differences

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert differences(df, con, ORACLE[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["model", "segment", "count", "mean_actual", "mae", "rmse", "r2"]
    assert df.count() == 3


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
