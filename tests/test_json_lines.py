"""JSON Lines files: each record by itself, with its place in the file."""

import pytest

from strataloom.artifact.schema import FAMILIES, TABLES
from strataloom.extract.engine import extract, extract_file, family

TEXT = '{"a": 1, "é": "x"}\r\n\n  \n{"a": {"b": 2}}\n{"a": }\n{"a": }\n[{"c": "ü", "d": 3}]'


@pytest.mark.parametrize("path", ["d/x.jsonl", "x.NDJSON"])
def test_records(path):
    fam = extract_file(path, "json", TEXT)
    raw = TEXT.encode()
    assert [(d["kind"], d["start_line"]) for d in fam["parse_diagnostics"]] == [("error", 5), ("error", 6)]
    assert [(s["name"], s["start_line"]) for s in fam["symbols"]] == [("a", 1), ("é", 1), ("a", 4), ("b", 4), ("a", 5), ("a", 6), ("c", 7), ("d", 7)]
    for s in fam["symbols"]:
        assert raw[s["start_byte"] : s["end_byte"]].decode().lstrip().startswith(f'"{s["name"]}"')
        assert s["start_byte"] - s["start_column"] == raw.rfind(b"\n", 0, s["start_byte"]) + 1
    assert [c["start_line"] for c in fam["complexity_metrics"] if c["scope"] == "file"] == [1, 4, 5, 6, 7]
    for f in FAMILIES:
        keys = [r[TABLES[f].names[0]] for r in fam[f]]
        assert len(keys) == len(set(keys)), f


def test_one_record_is_as_a_file_of_its_own():
    one = '{"k": {"l": [1, "s"]}}'
    a, b = extract_file("x.jsonl", "json", one), extract_file("x.jsonl", "json", "\n" + one + "\n")
    assert [(r["name"], r["start_byte"] + 1) for r in a["symbols"]] == [(r["name"], r["start_byte"]) for r in b["symbols"]]
    assert {f: len(a[f]) for f in FAMILIES} == {f: len(b[f]) for f in FAMILIES} == {f: len(extract_file("x.json", "json", one)[f]) for f in FAMILIES}
    assert not any(extract_file("x.jsonl", "json", "\n \n").values())


def test_spark(spark):
    df = spark.createDataFrame([("1", "x.jsonl", "json", TEXT)], "file_id string, path string, language string, text string")
    assert family(extract(df, "symbols"), "symbols").count() == 8


def test_scan(spark, tmp_path):
    from strataloom.artifact.engine import Engine

    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    e = Engine(spark, str(tmp_path / "artifact"), str(tmp_path / "src"))
    e.scan(level="symbols")
    e.store.views()
    assert spark.table("parse_diagnostics").count() == 0
    assert sorted(r.start_line for r in spark.table("symbols").collect()) == [1, 2]
