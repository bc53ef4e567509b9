import pytest

from conftest import DATA, same
from strataloom.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    same(spark, duck, name, QUERIES, ORACLE)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    if name.startswith("extract_") and name not in ("extract_symbols", "extract_table_counts"):
        pytest.skip("one pass covers all families")
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
