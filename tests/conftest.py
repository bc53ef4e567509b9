import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(normal(x) for x in v.asDict().values())
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def same(spark, duck, name, queries, oracle):
    """The Spark query and its SQL give the same rows and column names."""
    df = queries[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = duck.execute(oracle[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    assert mine == theirs
