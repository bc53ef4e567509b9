import pytest
from pyspark.sql import functions as F

from strataloom.artifact.engine import Engine, capability_fingerprint, check
from strataloom.artifact.schema import FAMILIES, TABLES
from strataloom.artifact.store import ArtifactError, foreign_key_check
from strataloom.operators.integrity import difference

GO = "package b\n\n// F does it.\nfunc F(n int) int {\n\tif n > 1 {\n\t\treturn 1\n\t}\n\treturn G(n)\n}\n\nfunc G(n int) int { return n }\n"


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "a" / "x y+z.py").write_text("import os\n\nclass A:\n    def f(self, n):\n        return g(n)\n\ndef g(n):\n    return n\n")
    (src / "b.go").write_text(GO)
    (src / "c.bin").write_bytes(b"\x00")
    (src / "node_modules" / "skip.js").write_text("x")
    return src


def test_life_cycle(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "out"), str(tree))
    first = e.scan()
    assert first["changes"] == {"inserted": 2, "unsupported": 1}
    assert e.scan()["status"] == "no_change" and e.store.version() == 1
    assert {r.path for r in e.store.read("files").collect()} == {"a/x y+z.py", "b.go", "c.bin"}
    assert e.store.read("relationships").count() == 2
    before = {f: e.store.read(f, 1).where(F.lit(True)) for f in ("symbols", "identifiers")}
    (tree / "b.go").write_text(GO + "\nfunc H() int { return F(2) }\n")
    assert e.update("b.go")["status"] == "changed" and e.update("b.go")["status"] == "no_change"
    assert e.store.read("symbols").where("name = 'H'").count() == 1
    assert before["symbols"].where("name = 'H'").count() == 0
    # an unreadable file keeps its rows
    (tree / "b.go").write_bytes(b"\xff\xff\xff")
    assert e.update("b.go")["status"] == "failed"
    assert e.store.read("symbols").where("path = 'b.go'").count() > 0
    assert e.store.read("files").where("path = 'b.go'").first().status == "failed_preserved"
    assert e.delete("a/x y+z.py")["status"] == "changed" and e.delete("nothing")["status"] == "not_found"
    assert foreign_key_check(e.store).where("dangling > 0").count() == 0
    info = e.info()
    assert info["files"].count() == 2 and info["totals"].count() == len(TABLES)
    e.store.views("t_")
    assert spark.sql("SELECT count(*) AS n FROM t_symbols").first().n == e.store.read("symbols").count()


def test_incremental_equals_full(spark, tree, tmp_path):
    a = Engine(spark, str(tmp_path / "a"), str(tree))
    a.scan()
    (tree / "b.go").write_text(GO.replace("G(n)", "K(n)"))
    (tree / "new.rs").write_text("fn f() { g() }\nfn g() {}\n")
    (tree / "a" / "x y+z.py").unlink()
    assert a.scan()["changes"] == {"updated": 1, "inserted": 1, "deleted": 1}
    b = Engine(spark, str(tmp_path / "b"), str(tree))
    b.scan()
    for f in FAMILIES:
        assert difference(a.store.read(f), b.store.read(f)).count() == 0, f


def test_only_changed_files_are_read_extracted_and_written(spark, tree, tmp_path, monkeypatch):
    from strataloom.artifact import engine as module

    e = Engine(spark, str(tmp_path / "out"), str(tree))
    first = e.scan()
    assert first["counts"]["symbols"] == e.store.read("symbols").count() > 0
    read: list = []
    true = module.read_listed
    monkeypatch.setattr(module, "read_listed", lambda s, r, listed: read.append({x.path for x in listed.collect()}) or true(s, r, listed))
    assert e.scan()["status"] == "no_change" and not read
    (tree / "b.go").write_text(GO + "// more\n")
    assert e.scan()["changes"] == {"updated": 1} and read.pop() == {"b.go"}
    m = e.store.manifest()
    part = spark.read.parquet(f"{e.store.base}/{m['parts']['symbols'][1]}")
    assert {r.path for r in part.select("path").distinct().collect()} == {"b.go"} and len(m["parts"]["symbols"]) == 2
    log = {r.revision_id: r for r in e.store.read("extraction_revisions").collect()}
    assert '"symbols": 3' in log[2].counts_json and log[2].parent_revision_id == 1
    before = {f: e.store.read(f) for f in FAMILIES}
    rows = {f: sorted(map(str, before[f].collect())) for f in FAMILIES}
    e.store.compact()
    assert e.store.manifest()["dead"] == [] and {f: sorted(map(str, e.store.read(f).collect())) for f in FAMILIES} == rows
    assert e.scan()["status"] == "no_change"


def test_progress_and_failures_are_told(spark, tree, tmp_path):
    told: list = []
    e = Engine(spark, str(tmp_path / "out"), str(tree), progress=told.append)
    e.scan()
    assert [t["phase"] for t in told] == ["discover", "extract", "commit", "done"] and told[-1]["revision_id"] == 1
    n = e.store.read("symbols").where("path = 'b.go'").count()
    (tree / "b.go").write_bytes(b"\xff\xff\xff")
    (tree / "new.go").write_bytes(b"\xff")
    e.scan()
    d = {r.path: (r.kind, r.message) for r in e.store.read("parse_diagnostics").collect()}
    assert d == {p: ("read_failed", "content cannot be decoded: invalid_utf8") for p in ("b.go", "new.go")}
    assert e.store.read("symbols").where("path = 'b.go'").count() == n > 0 and e.scan()["status"] == "no_change"
    (tree / "b.go").write_text(GO)
    e.scan()
    assert {r.path for r in e.store.read("parse_diagnostics").collect()} == {"new.go"}


def test_a_file_above_the_limit_gets_a_warning(spark, tree, tmp_path):
    (tree / "big.py").write_text("x = 1\n" * 200_000)
    e = Engine(spark, str(tmp_path / "out"), str(tree))
    e.scan()
    d = e.store.read("parse_diagnostics").where("path = 'big.py'").collect()
    assert [r.kind for r in d] == ["slow_file_skipped"] and "1048576" in d[0].message
    assert e.store.read("symbols").where("path = 'big.py'").count() == 0
    assert e.scan()["status"] == "no_change"
    (tree / "big.py").write_text("def f(): pass\n")
    e.scan()
    assert e.store.read("parse_diagnostics").count() == 0 and e.store.read("symbols").where("path = 'big.py'").count() == 1


def test_the_journal_is_consumed_once(spark, tree, tmp_path):
    from strataloom.operators.ledger import WorkLedger

    e = Engine(spark, str(tmp_path / "out"), str(tree))
    e.scan()
    led = WorkLedger(spark, str(tmp_path / "led"))
    assert e.consume(led, "w", lambda changes: changes) == ["r000000001"]
    e.delete("b.go")
    assert e.consume(led, "w", lambda changes: changes) == ["r000000002"] and e.consume(led, "w", lambda c: c) == []
    assert led.results().count() == e.store.read("revision_file_changes").count() == 4


def test_gates(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "out"), str(tree))
    with pytest.raises(ArtifactError) as x:
        e.info()
    assert x.value.code == "no_artifact"
    with pytest.raises(ArtifactError):
        e.scan(level="none")
    e.scan(level="symbols")
    assert e.store.read("identifiers").count() == 0 and e.store.read("symbols").count() > 0
    with pytest.raises(ArtifactError) as x:
        e.scan(level="full")
    assert x.value.code == "level_conflict"
    with pytest.raises(ArtifactError) as x:
        Engine(spark, str(tmp_path / "out"), "/other").scan()
    assert x.value.code == "root_mismatch"
    meta = e.store.manifest()["metadata"]
    with pytest.raises(ArtifactError):
        e.rebind(str(tree), "wrong", "/new")
    assert e.rebind(str(tree), meta["artifact_id"], "/new")["root_path"] == "/new"
    with pytest.raises(ArtifactError) as x:
        e.store.commit(meta, 1)
    assert x.value.code == "conflict"


def test_check_and_languages(spark, tmp_path):
    assert check("a.py", "def f(:\n", "python") and not check("a.py", "x = 1\n", "python")
    e = Engine(spark, str(tmp_path / "x"))
    assert e.languages().count() == 42
    assert capability_fingerprint(spark).first().fingerprint == capability_fingerprint(spark).first().fingerprint


def test_stream(spark, tree, tmp_path):
    from strataloom.streaming.trigger import follow

    e = Engine(spark, str(tmp_path / "out"), str(tree))
    follow(e, str(tree), str(tmp_path / "cp")).awaitTermination(120)
    n = e.store.read("files").count()
    assert n >= 3
    (tree / "late.py").write_text("def late(): pass\n")
    follow(e, str(tree), str(tmp_path / "cp")).awaitTermination(120)
    assert e.store.read("symbols").where("name = 'late'").count() == 1
