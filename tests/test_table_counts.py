"""Counts of the row families: taken where the files are read, the same as from the tables with their keys enforced."""

from collections import Counter

from pyspark.sql import functions as F

from conftest import DATA
from strataloom.artifact.schema import FAMILIES
from strataloom.artifact.store import enforce
from strataloom.extract.engine import extract, family
from strataloom.plans import registry
from strataloom.session import table

QUERIES = registry.queries()


def test_no_row_leaves_its_task(spark):
    plan = QUERIES["extract_table_counts"](spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Join", "Broadcast", "InMemoryTableScan", "Generate"))


def test_as_enforced_tables(spark):
    files = table(spark, DATA, "file_snapshots").select("file_id", "path", "language", F.col("content").alias("text")).distinct()
    tables = enforce({f: family(extract(files), f) for f in FAMILIES})
    want = Counter()
    for f in FAMILIES:
        if "language" in tables[f].columns:
            want.update({(f, r.language): r["count"] for r in tables[f].groupBy("language").count().collect()})
    df = QUERIES["extract_table_counts"](spark, DATA)
    got = {(r.family, r.language): r.rows for r in df.collect()}
    assert df.columns == ["family", "language", "rows"] and {k: got[k] for k in want} == want


def test_every_family_counts(spark, tmp_path):
    java = "@Entity\nclass A extends B {\n\n  Map<String, List<User>> m = f();\n  void g() { h(); }\n  void h() { x.y(); }\n}\n"
    vue = "<template><p>a</p></template>\n<script lang=\"ts\">\nfunction f(x: Box<Item>) { return g(x) }\nfunction g(x) { return 1 }\n</script>\n"
    rows = [("1", "A.java", "java", java), ("2", "b.vue", "vue", vue), ("3", "c.py", "python", None)]
    spark.createDataFrame(rows, "file_id string, path string, language string, content string").write.parquet(f"{tmp_path}/file_snapshots.parquet")
    got = {(r.family, r.language): r.rows for r in QUERIES["extract_table_counts"](spark, str(tmp_path)).collect()}
    assert got["type_arguments", "java"] == 3 and got["type_arguments", "typescript"] == 1
    assert got["relationships", "java"] == 1 and got["relationships", "typescript"] == 1 and got["pending_relationships", "java"] == 3 and got["symbol_annotations", "java"] == 1


def test_all_rows_count(spark):
    files = table(spark, DATA, "file_snapshots").select("file_id", "path", "language", F.col("content").alias("text")).distinct()
    tables = enforce({f: family(extract(files), f) for f in FAMILIES})
    got = Counter()
    for r in QUERIES["extract_table_counts"](spark, DATA).collect():
        got[r.family] += r.rows
    assert got == Counter({f: tables[f].count() for f in FAMILIES}) and got["type_arguments"] > 0
