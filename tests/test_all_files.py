"""Queries over every file and level, on a small fixture and by brute force."""

import pytest

from strataloom.operators.reports import LEVELS
from strataloom.plans import registry

QUERIES = registry.queries()
FILES = [
    ("1", "a.go", "go", "package p\n// TODO: x\n// TODO: x\nfunc F() { s := \"// TODO: no\"; g(s) } // FIXME y\n"),
    ("2", "b.ts", "typescript", "/* HACK: a\n * TODO(me): b\n */\nfunction f(x) { return g(x) }\n"),
    ("3", "c.toml", "toml", "# XXX: t\na = 1\n"),
    ("4", "d.py", "python", "x = 'a  b'  # TODO\nx += 1\n"),
    ("5", "e.py", "python", "x   =   'a  b'\n\n# other\nx += 1\n"),
    ("6", "f.py", "python", "x = 'a b'\nx += 1\n"),
    ("7", "g.js", "javascript", "function f( {\n"),
    ("8", "h.js", "javascript", None),
]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("files"))
    spark.createDataFrame(FILES + FILES[:3], "file_id string, path string, language string, content string").write.parquet(f"{d}/file_snapshots.parquet")
    return d


def test_markers(spark, data):
    got = {tuple(r) for r in QUERIES["comment_markers_all"](spark, data).collect()}
    assert got == {("1", "TODO", 2), ("1", "FIXME", 1), ("2", "HACK", 1), ("2", "TODO", 1), ("3", "XXX", 1), ("4", "TODO", 1)}


def test_token_hashes(spark, data):
    rows = QUERIES["token_hashes_all"](spark, data).collect()
    h = {r.file_id: r.token_hash for r in rows}
    assert len(rows) == len(h) == len(FILES) and h["8"] is None
    assert h["4"] == h["5"] != h["6"] and len(set(h.values())) == 7


def test_levels(spark, data):
    from strataloom.extract.engine import extract_file

    got = {r.level: (r.symbols, r.facts, r.relationships, r.identifiers) for r in QUERIES["extracted_levels"](spark, data).collect()}
    want = {}
    for level in LEVELS:
        fams = [extract_file(p, l, t, i, level) for i, p, l, t in FILES if t is not None]
        want[level] = tuple(sum(len(f[n]) for f in fams for n in names) for names in (["symbols"], ["structural_facts"], ["relationships", "pending_relationships"], ["identifiers"]))
    assert got == want and got["full"][3] > 0 and got["references"][2] > 0 == got["facts"][2]


def test_access_and_syntax(spark, data):
    access = {(r.language, r.access): r.n for r in QUERIES["identifier_access"](spark, data).collect()}
    assert access[("python", "read_write")] == 3 and ("typescript", "read") in access
    assert {(r.path, r.kind) for r in QUERIES["syntax_check_files"](spark, data).collect()} == {("g.js", "missing")}
