"""No fixed windows: long calls, signatures and types lose nothing."""

import json

import pytest

from strataloom.extract.engine import extract_file

LONG = "alpha + " * 100 + "omega"


def calls(language, text):
    return {i["name"]: json.loads(i["metadata_json"] or "{}").get("arg_count") for i in extract_file("f", language, text)["identifiers"] if i["kind"] == "call"}


def literals(language, text):
    return [(l["kind"], l["carrier"], l["arg_position"], l["literal_text"]) for l in extract_file("f", language, text)["literals"]]


def test_literal_after_a_long_argument():
    assert literals("python", f"db.execute({LONG}, 'select 1')\n") == [("sql", "db.execute", 1, "select 1")]
    many = ", ".join(f"g(a{i}, [b, c])" for i in range(300))
    assert literals("go", f'package p\n\nfunc f() {{\n\tdb.query({many}, "select 2")\n}}\n') == [("sql", "db.query", 300, "select 2")]
    chain = ".".join(["part"] * 100)
    assert literals("java", f'class A {{ void f() {{ {chain}.query("select 3"); }} }}\n') == [("sql", f"{chain}.query", 0, "select 3")]
    assert literals("python", "db.execute(" + " " * 500 + "'select 4')\n") == [("sql", "db.execute", 0, "select 4")]


def test_literals_in_inner_brackets_are_no_arguments():
    assert literals("python", "db.execute([1, 'a'], {'k': 'v'})\nx = ('select', 1)\n") == []


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("python", f"f({LONG}, 2)\n", {"f": 2}),
        ("python", "f(g(1, 2), [3, 4], h())\n", {"f": 3, "g": 2, "h": 0}),
        ("python", "f(1, 2,)\ng(lambda a, b: a, 1)\nh(x for x, y in z)\n", {"f": 2, "g": 2, "h": 1}),
        ("python", "f(')', \"(\", 1)\n", {"f": 3}),
        ("rust", "fn m() { f(|a, b| a, 1); g(HashMap::<A, B>::new(), 2); h('(', 1); }\n", {"f": 2, "g": 2, "h": 2}),
        ("java", "class A { void m() { f(new Map<A, B>(), x < 3, y > 2); } }\n", {"f": 3}),
        ("javascript", "f(a < b, c > d);\ng(a<b, c>(d));\n", {"f": 2, "g": 2}),
        ("go", "package p\nfunc m() { f(1, 2\n}\n", {"f": None}),
    ],
)
def test_arguments(language, text, want):
    got = calls(language, text)
    assert {k: got.get(k, "no call") for k in want} == want


def test_texts_are_whole():
    params = ", ".join(f"a{i}: int" for i in range(400))
    fam = extract_file("f.py", "python", f"def f({params}) -> Tuple[{'int, ' * 300}int]:\n    pass\n")
    (s,) = (x for x in fam["symbols"] if x["name"] == "f")
    assert "a399: int" in s["signature"] and len(fam["type_facts"][0]["resolved_type"]) > 1000


def test_words_and_receivers_of_any_distance():
    got = {i["name"]: i for i in extract_file("f.java", "java", f"class A implements{' ' * 30}Base {{ void f() {{ {'r' * 200}.go(); }} }}\n")["identifiers"]}
    assert got["Base"]["kind"] == "type_usage"
    assert json.loads(got["go"]["metadata_json"])["receiver"] == "r" * 200
