"""Resolution variants, re-homing, rekeying, audits, and relations in SQL and YAML texts."""

import pytest
from pyspark.sql import functions as F

from strataloom.extract.engine import extract_file
from strataloom.functions import text
from strataloom.operators import audit, integrity, scope
from strataloom.operators.sqltext import select_flags

SYMBOLS = [
    ("m", "f", "M", "module", None, 0), ("c", "f", "C", "class", "m", 5), ("a", "f", "run", "method", "c", 10), ("b", "f", "go", "method", "c", 20), ("b2", "f", "go", "method", "c", 30),
    ("x", "f", "run", "function", "m", 40), ("l", "f", "inner", "function", "a", 12), ("p", "f", "mac", "macro", "m", 1), ("q", "f", "mac", "macro", "m", 50), ("r", "f", "mac", "macro", "m", 3),
    ("k1", "f", "k1", "class", "k2", 60), ("k2", "f", "k2", "class", "k1", 61), ("k3", "f", "k3", "method", "k1", 62), ("c", "f", "C", "class", "m", 5),
]
SCHEMA = "symbol_id string, file_id string, name string, kind string, parent_symbol_id string, start_byte long"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, SCHEMA)


def test_self_receiver(spark, symbols):
    refs = spark.createDataFrame([(1, "l", "run"), (2, "a", "go"), (3, "x", "run"), (4, "a", "none"), (5, None, "run")], "reference_id long, caller_id string, name string")
    got = {r.reference_id: (r.outcome, r.target_id) for r in scope.resolve_self_receiver(refs, symbols).collect()}
    assert got == {1: ("resolved", "a"), 2: ("ambiguous", None), 3: ("missing", None), 4: ("missing", None), 5: ("missing", None)}


def test_constructable(spark, symbols):
    refs = spark.createDataFrame([(1, "f", "a", "C"), (2, "f", "a", "run")], "reference_id long, file_id string, caller_id string, name string")
    got = {r.reference_id: (r.outcome, r.target_id) for r in scope.resolve_constructable(refs, symbols).collect()}
    assert got == {1: ("resolved", "c"), 2: ("ambiguous", None)}


def test_preceding(spark, symbols):
    refs = spark.createDataFrame([(1, "f", "a", "mac", 15), (2, "f", "a", "mac", 2), (3, "f", "a", "mac", 0), (4, "f", "a", "mac", 90)], "reference_id long, file_id string, caller_id string, name string, at_byte long")
    assert {r.reference_id: r.target_id for r in scope.resolve_preceding(refs, symbols, ("macro",)).collect()} == {1: "r", 2: "p", 3: None, 4: "q"}


def test_retain(symbols):
    got = {r.symbol_id: r.parent_symbol_id for r in scope.retain(symbols, F.col("kind").isin("module", "function")).collect()}
    assert got == {"m": None, "x": "m", "l": "m"}
    assert {r.symbol_id: r.parent_symbol_id for r in scope.retain(symbols, F.col("kind") == "method").collect()} == {"a": None, "b": None, "b2": None, "k3": None}
    assert scope.retain(symbols.limit(0), F.lit(True)).count() == 0


def test_rekey_and_merge(spark):
    t = {"s": spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone")], "id string, up string"), "r": spark.createDataFrame([("b", "c")], "src string, dst string")}
    out = integrity.rekey(t, "s", "id", F.upper("id"), [("s", "up"), ("r", "src"), ("r", "dst")])
    assert sorted(map(tuple, out["s"].collect()), key=str) == [("A", None), ("B", "A"), ("C", "gone")] and out["r"].first() == ("B", "C")
    old, new = spark.createDataFrame([("a", 1), ("b", None)], "id string, v int"), spark.createDataFrame([("a", 2), ("b", None), ("c", 3)], "id string, v int")
    merged, odd = integrity.merge_first(old, new, "id")
    assert sorted(map(tuple, merged.collect()), key=str) == [("a", 1), ("b", None), ("c", 3)] and [tuple(r) for r in odd.collect()] == [("a", 2)]


def test_audits(spark):
    rows = spark.createDataFrame([(1, "f", 0, 3, "é"), (2, "f", 1, 3, "x"), (3, "f", 0, 99, "x"), (4, "g", 0, 1, "x"), (5, "f", 2, 4, "y")], "id long, file_id string, start_byte long, end_byte long, name string")
    snaps = spark.createDataFrame([("f", "éxyz")], "file_id string, content string")
    assert {r.id: r.verdict for r in audit.span_check(rows, snaps, "name").collect()} == {1: "holds", 2: "outside", 3: "outside", 4: "no_file", 5: "holds"}
    reg, here = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "p string"), spark.createDataFrame([("b",), ("c",)], "p string")
    assert sorted(map(tuple, audit.reconcile(reg, here, "p").collect())) == [("a", "missing"), ("c", "unlisted")]
    claims = spark.createDataFrame([("go", "d", "yes"), ("go", "d", "no"), ("c", "d", "yes"), ("c", "e", None)], "language string, domain string, bucket string")
    assert sorted((r.language, r.domain) for r in audit.claim_conflicts(claims, ["language", "domain"], "bucket").collect()) == [("c", "e"), ("go", "d")]
    assert {r.domain: (r.yes, r.no) for r in audit.by_bucket(claims, "domain", "bucket", "language", ["yes", "no"]).collect()} == {"d": (["c", "go"], ["go"]), "e": ([], [])}
    assert {r.language: (r.cells, r.open) for r in audit.open_gaps(claims, "language", "bucket").collect()} == {"go": (2, 0), "c": (2, 1)}
    a, b = spark.createDataFrame([(1, "x", None, "t1"), (2, "y", 1, "t1"), (3, "z", 1, "t")], "k long, v string, n int, at string"), spark.createDataFrame([(1, "x", None, "t2"), (2, "y", 2, "t2")], "k long, v string, n int, at string")
    assert sorted(map(tuple, audit.receipts_differ(a, b, "k", ("at",)).collect())) == [(2, "n"), (3, "*")]
    assert {r.column: r.stable for r in audit.stable_evidence(a, ["v", "n", "at"]).collect()} == {"v": False, "n": False, "at": False}
    assert {r.column: r.stable for r in audit.stable_evidence(a.limit(1), ["v", "n"]).collect()} == {"v": True, "n": True}


def test_sql_relations():
    sql = "CREATE TABLE users (id int PRIMARY KEY);\nCREATE TABLE orders (id int, uid int REFERENCES users(id), x int references gone(id));\nSELECT * FROM users u LEFT JOIN orders o ON true JOIN (SELECT 1 FROM orders WHERE 'GROUP BY' = a) q ON true ORDER BY 1;\n"
    fam = extract_file("a.sql", "sql", sql)
    assert [(r["kind"], sql[r["start_byte"] : r["end_byte"]]) for r in fam["relationships"]] == [("references", "users"), ("joins", "orders")]
    assert [p["target_display_name"] for p in fam["pending_relationships"]] == ["gone"]
    assert select_flags(sql, sql.index("SELECT")) == {"has_where": False, "has_group_by": False, "has_order_by": True}


def test_yaml_aliases():
    y = "base: &b\n  k: v\nbase2: &b\n  k: w\nuse:\n  <<: *b\n---\nother: *b\n"
    fam = extract_file("a.yaml", "yaml", y)
    ids = {s["symbol_id"]: s["name"] for s in fam["symbols"]}
    assert [(ids[r["from_symbol_id"]], ids[r["to_symbol_id"]], r["start_line"]) for r in fam["relationships"]] == [("use", "base2", 6)]


def test_texts(spark):
    assert text.unescape(r"a\n\xe9\u{1F600}😀\"\q\\") == 'a\né😀😀"q\\'
    df = spark.createDataFrame([('"a\\tb"',), ("'x'",), (None,), ("plain",)], "raw string")
    assert [r.v for r in df.select(text.string_value(F.col("raw")).alias("v")).collect()] == ["a\tb", "x", None, "plain"]
    assert [text.toml_string(x) for x in ('"a\\nb"', "'a\\nb'", '"""\nx\\\n   y"""', "'''\nz'''", "5")] == ["a\nb", "a\\nb", "xy", "z", None]
    assert [text.yaml_scalar(x) for x in ('"a\\tb"', "'it''s'", "a\n  b", " p ")] == ["a\tb", "it's", "a b", "p"]
    assert text.folded_pattern("(?x)\n a # c\n [#] b\n") == "(?x)a[#] b" and text.folded_pattern("a #\n b") == "a #b"
    rows = spark.createDataFrame([("/api/", "/u"), ("/api", "u"), ("/api", "/u"), ("/api/", "u"), ("/api/", "")], "p string, t string")
    assert [r.j for r in rows.select(text.join_route(F.col("p"), F.col("t")).alias("j")).collect()] == ["/api/u", "/api/u", "/api/u", "/api/u", "/api/"]
