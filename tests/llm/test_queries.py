import pytest

from conftest import DATA, same
from strataloom.llm import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    same(spark, duck, name, QUERIES, ORACLE)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_nothing_else_imports_this():
    import pathlib

    import strataloom

    root = pathlib.Path(strataloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "strataloom.llm" not in p.read_text()
