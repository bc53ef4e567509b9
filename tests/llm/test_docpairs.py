import pytest

from strataloom.llm import docpairs
from strataloom.llm.docpairs import captured, functions, says_something

NOTHING = [
    (None, "f"), ("", "f"), ("/** */", "f"), ("//", "f"), ("# ----------", "f"), ("/*****\n *****/", "f"), ('"""\n"""', "f"), ("TODO", "f"), ("// TODO(me): write docs", "f"), ("FIXME explain this", "f"),
    ("To do [X-1]: describe params", "f"), ("No description.", "f"), ("n/a", "f"), ("...", "f"), ("See above.", "f"), ("{@inheritDoc}", "f"), ("Same as above", "f"), ("https://example.org/x", "f"),
    ("# noqa: E501", "f"), ("// eslint-disable-next-line no-console", "f"), ("//nolint:errcheck", "f"), ("//go:noinline", "f"), ("// @ts-ignore", "f"), ("# type: ignore", "f"), ("/* istanbul ignore next */", "f"),
    ("Copyright (c) 2020 the authors.\nAll rights reserved.", "f"), ("SPDX-License-Identifier: MIT", "f"), ("@author someone\n@since 1.0", "f"), ("Created on 2020-01-02", "f"), ("Code generated by protoc. DO NOT EDIT.", "f"),
    ("This method was generated by the build. Do not modify.", "f"), ("@param x\n@return", "f"), (":param x:\n:rtype: int", "f"), ("Args:\nReturns:", "f"), ("@param {number} count\n@returns {number}", "f"), ("@param count the count", "f"),
    ("// const x = drop(3);\n// return x;", "drop"), ("# x = drop(3)", "drop"), ("if (x > 3) {", "f"), ("Drops the window.", "drop_window"), ("This function drops a window", "dropWindow"), ("dropWindow - drop window", "dropWindow"),
    ("Trimming the headers", "trimHeader"), ("<p>\n</p>", "f"), ("<summary>\n/// </summary>", "f"), ("TODO: write\nDrop window.", "dropWindow"),
    ("Siehe oben.", "f"), ("voir plus bas", "f"), ("待补充", "f"), ("説明なし", "f"), ("Nicht dokumentiert", "f"), ("Keine Beschreibung.", "f"), ("см. выше", "f"), ("Sin documentar", "f"), ("설명 없음", "f"),
]
SOMETHING = [
    ("Never null.", "f"), ("/** Returns -1 when absent. */", "f"), ("Idempotent.", "f"), ("@param limit upper bound; zero turns it off", "f"), (":return: the merged list, sorted by path", "f"), ("Strips the licence header from the file.", "f"),
    ("Removes placeholder text from the page.", "f"), ("Turns TODO comments into rows.", "f"), ("Returns the auto-generated key of the row.", "f"), ("Handles old names. TODO: drop this.", "f"), ("指定された範囲を返す。", "f"),
    ("Возвращает первый элемент.", "f"), ("TODO: docs\nKeeps every window in order", "f"), ("Copyright 2020 x.\nReads one token ahead.", "f"), ("Prints a ----- rule between blocks.", "f"), ("Drops the window unless it is open.", "drop_window"),
    ("# pylint: disable=x\n# Sorts by length first.", "f"), ("Args:\n    n: how many rows to keep", "f"), ("O(n log n) in the size.", "f"), ("Siehe oben. Wirft bei leerer Eingabe.", "f"), ("Renvoie la plus longue ligne.", "f"), ("返回最后一个元素。", "f"), ("設定オブジェクトへの参照を返す。", "f"), ("/**\n * @deprecated use g, which locks\n */", "f"),
]


def capture(data, language, start, body_start, end):
    return captured(functions(data, language), data, start, body_start, end)


@pytest.mark.parametrize("doc,name", NOTHING)
def test_says_nothing(doc, name):
    assert not says_something(doc, name)


@pytest.mark.parametrize("doc,name", SOMETHING)
def test_says_something(doc, name):
    assert says_something(doc, name)


def test_capture_protects_strings():
    src = "/** Doc. */\nfunction f(a) {\n  const s = '}'; // }\n  const r = /[{]/;\n  return `${a}}`;\n}\nnext();\n".encode()
    start, body = src.index(b"function"), src.index(b"{\n")
    got = capture(src, "javascript", start, body, len(src))
    assert got["by"] == "pattern" and got["comment"] == "/** Doc. */" and got["body"].endswith("`;\n}") and got["signature"] == "function f(a)"


def test_capture_python_and_damage():
    src = b"# Doc.\ndef f(a, b=(1, 2)):\n    '''x: y'''\n    return {\n        'k': a}\n\ny = 1\n"
    got = capture(src, "python", src.index(b"def"), src.index(b":\n") + 1, len(src))
    assert got["by"] == "pattern" and "return {" in got["body"] and "y = 1" not in got["body"] and got["comment"] == "# Doc."
    cut = b"func f() {\n\tif x {\n"
    assert capture(cut, "go", 0, cut.index(b"{"), len(cut))["by"] == "span"


def test_functions_within_functions_and_long_runs():
    src = b"/* a */\n// b\nexport function outer(x: number): number {\n  if (x) { y(); }\n  /** in */\n  const inner = (a = '}') => {\n    return a;\n  };\n}\nclass C {\n  m() {\n  }\n}\n"
    found = functions(src, "typescript")
    names = sorted((m["signature"].split(b"(")[0].strip(), m["comment"].strip()) for m in found.values())
    assert names == [(b"const inner =", b"/** in */"), (b"export function outer", b"/* a */\n// b"), (b"m", b"")]
    deep = b"fn f() {" + b"{" * 20_000 + b"}" * 20_000 + b"}\n"
    assert len(functions(deep, "rust")) == 1
    assert functions(b"fn f() {" * 3_000, "rust") == {} and functions(b"", "go") == {}


def test_a_long_file_is_cut_to_its_regions(spark):
    """Functions all over a file of several regions, one longer than a region: each is found by the pattern."""
    parts, rows, at = [], [], 0
    for i in range(400):
        body = "{\n" + "\tx := \"}é\"\n" * (2000 if i == 7 else 20) + "}\n"
        head = f"// Keeps item {i} locked.\nfunc F{i}(a int) "
        text = head + body
        n, h = len(text.encode()), len(head.encode())
        rows.append((str(i), "f", "go", f"F{i}", "function", f"// Keeps item {i} locked.", at + head.index("func"), at + n - 1, at + h, at + n - 1, "x"))
        parts.append(text)
        at += n
    sym = spark.createDataFrame(rows, SYM)
    out = docpairs.pairs(sym, spark.createDataFrame([("f", "".join(parts))], "file_id string, content string")).collect()
    assert len(out) == 400 and {r.cut_by for r in out} == {"pattern"}
    got = {r.symbol_id: r for r in out}
    assert all(got[str(i)].signature == f"func F{i}(a int)" and got[str(i)].comment == f"// Keeps item {i} locked." for i in range(400))
    assert got["7"].body.count("é") == 2000


def test_nearly_all_come_by_the_pattern(spark):
    from strataloom.llm.queries import QUERIES

    rows = QUERIES["p1_pairs"](spark, "/root/testdata/sf0.01").groupBy("cut_by").count().collect()
    n = {r.cut_by: r["count"] for r in rows}
    assert n["pattern"] > 0.99 * sum(n.values())


SYM = "symbol_id string, file_id string, language string, name string, kind string, doc_comment string, start_byte long, end_byte long, body_start_byte long, body_end_byte long, content string"


def test_pairs(spark):
    code = "// é says it all\nfunc F() {\n\treturn\n}\n"
    b = code.encode()
    s, e, o = b.index(b"func"), len(b) - 1, b.index(b"{")
    rows = [
        ("1", "f", "go", "F", "function", "// é says it all", s, e, o, e, "clash"), ("1", "f", "go", "F", "function", "// é says it all", s, e, o, e, "clash"), ("2", "f", "go", "F", "method", "// F", s, e, o, e, "x"),
        ("3", "f", "go", "F", "class", "Says much here", s, e, o, e, "x"), ("4", "f", "go", "F", "function", None, s, e, o, e, "x"), ("5", "gone", "go", "F", "function", "Blocks until done", s, e, o, e, "x"),
        ("6", "f", "go", "F", "function", "Blocks until done", s, e, None, None, "x"), (None, "f", "go", "F", "function", "Blocks until done", s, e, o, e, "x"), ("7", None, "go", None, "function", "Blocks until done", None, None, 10**9, None, "x"),
        ("8", "empty", None, "F", "function", "Blocks until done", s, e, o, e, "x"), ("9", "f", "go", "F", "function", "Blocks. " * 50_000, s, e, o, e, "x"),
    ]
    snaps = spark.createDataFrame([("f", code), ("f", code), ("empty", ""), (None, "x"), ("null", None)], "file_id string, content string")
    got = {r.symbol_id: r for r in docpairs.pairs(spark.createDataFrame(rows, SYM), snaps).collect()}
    assert set(got) == {"1", "5", "7", "8", "9"}
    assert got["1"].cut_by == "pattern" and got["1"].body == "{\n\treturn\n}" and got["1"].description == "é says it all"
    assert got["5"].body is None and got["7"].body is None
    assert docpairs.pairs(spark.createDataFrame([], SYM), snaps).count() == 0


@pytest.mark.parametrize(
    "language,text,n",
    [
        ("java", b"void f(int a) {\n" * 3000, 0), ("java", b"foo(bar(\n" * 3000, 0), ("javascript", b"a(`x\n" * 4001, 0), ("go", b"/* a\n" * 4000, 0),
        ("go", b"func F() {\n" + b'\tx := "}"\n' * 4000 + b"}\n", 1), ("typescript", b"x = a / b / c\n" * 4000, 0), ("python", b"def f(a, (\n" * 3000, 0), ("rust", b"fn f() {\n" + b"{" * 9000 + b"}" * 9000 + b"\n}\n", 1),
    ],
)
def test_damaged_texts_take_no_longer_than_others(language, text, n):
    import time

    began = time.process_time()
    assert len(functions(text, language)) == n and time.process_time() - began < 5
