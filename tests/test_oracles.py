"""Every query with SQL gives DuckDB's rows; every other one runs, with a stable schema."""

import pytest
from compare import DATA, duck, spark_rows

from evidentia.plans import registry

ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, name):
    found, wanted = spark_rows(registry.queries()[name](spark, str(DATA))), duck(ORACLES[name])
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    assert found[1] == wanted[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, str(DATA))
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
