import pytest
from pyspark.sql import functions as F

from strataloom.functions import ids, text
from strataloom.sources.languages import LANGUAGES, detect
from strataloom.sources.snapshot import decode_status, snapshots


def one(spark, expr, *values, kinds=None):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} {k}" for c, k in zip(cols, kinds or ["string"] * len(values))))
    return df.select(expr(*map(F.col, cols)).alias("x")).collect()[0].x


@pytest.mark.parametrize("value,want", [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("\n", 1), ("\n\n", 2), (None, None)])
def test_line_count(spark, value, want):
    assert one(spark, text.line_count, value) == want


@pytest.mark.parametrize("value,want", [("./a//b", "a/b"), ("a\\b\\c", "a/b/c"), (" a/b ", "a/b"), ("././x", "x"), ("", "")])
def test_normalize_path(spark, value, want):
    assert one(spark, text.normalize_path, value) == want


def test_ids(spark):
    import hashlib

    want = "site-" + hashlib.sha256(b"f\x1f1\x1f\x1f").hexdigest()[:32]
    assert one(spark, lambda a, b, c: ids.stable_id("site", a, b, c), "f", "1", None) == want
    assert one(spark, lambda a: ids.content_hash(a), "abc") == "sha256:" + hashlib.sha256(b"abc").hexdigest()
    assert one(spark, lambda a: ids.render_value(a, "bigint"), 3, kinds=["bigint"]) == "int:3" and one(spark, lambda a: ids.render_value(a, "string"), None) == "null:"
    assert one(spark, lambda a: ids.render_value(a, "string"), "a\tb\\") == "text:a\\tb\\\\"


@pytest.mark.parametrize("value,want", [("&mut Vec<u8>", "Vec"), ("string?", "string"), ("List<Map<A, B>>", "List"), ("int[]", "int"), ("*const T", "T")])
def test_strip_type_decorations(spark, value, want):
    assert one(spark, text.strip_type_decorations, value) == want


def test_chain(spark):
    r = one(spark, text.chain_target, "a::b.c->d")
    assert (r.display, r.terminal, r.receiver, list(r.namespace)) == ("a::b.c->d", "d", "c", ["a", "b"])
    r = one(spark, text.chain_target, "x")
    assert (r.terminal, r.receiver, list(r.namespace)) == ("x", None, [])


@pytest.mark.parametrize(
    "line,want", [("TODO(me): x y", ("TODO", "me", "x y")), ("FIXME", ("FIXME", None, None)), ("HACK - why", ("HACK", None, "- why")), ("todo: x", (None, None, None)), ("a TODO", (None, None, None))]
)
def test_marker(spark, line, want):
    r = one(spark, text.marker, line)
    assert (r.marker, r.owner, r.description) == want


def test_other_text(spark):
    assert one(spark, text.slug, " Hello, World! é_x ") == "hello-world-é_x"
    assert one(spark, text.sql_identifier, '[dbo]."T x"') == "dbo.T x" and one(spark, text.sql_string, "N'it''s'") == "it's"
    assert one(spark, text.string_literal, 'f"a{b}c"') == "a{}c" and one(spark, text.import_source_kind, "./a") == "relative"
    assert one(spark, text.tag_attributes, " a=\"1\" B='2' a=\"3\"") == {"a": "3", "b": "2"}
    assert one(spark, text.semantic_line, " * x */") == "x" and one(spark, text.normalize_label, "  A \n b ") == "a b"
    a, b = (one(spark, text.body_hash, t) for t in ("int x = 1; // c", "int x=1;"))
    assert a == b != one(spark, text.body_hash, "int x=2;")
    assert one(spark, text.regex_complexity, "(?:a|b)+[c]") == 5


def test_detect(spark):
    cases = {"a/x.RS": "rust", "go.mod": "gomod", "q/go.sum": "gosum", "Gemfile": "ruby", "x.unknown": None, "x": None, "a.tar.json": "json", "NAMESPACE": "r", ".bashrc": "bash"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.l for r in df.select("p", detect(F.col("p")).alias("l")).collect()} == cases
    content = [("x.h", "class A {};", "cpp"), ("x.h", "int f(void);", "c"), ("run", "#!/usr/bin/env bash\n", "bash"), ("run", "#!/usr/bin/env -S bash\n", "bash")]
    for p, t, want in content:
        assert one(spark, lambda a, b: detect(a, b), p, t) == want
    assert len(LANGUAGES) == 42


def test_decoding(spark):
    rows = [("u8.py", "é".encode()), ("le.py", b"\xff\xfe" + "é".encode("utf-16-le")), ("be.py", b"\xfe\xff" + "é".encode("utf-16-be")), ("odd.py", b"\xff\xfeabc"), ("bad.py", b"\xff\xff\xff"), ("e.py", b""), ("x.bin", b"\x00")]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r.path: (r.text, r.status, r.decode_status) for r in snapshots(df).collect()}
    assert got["u8.py"][0] == got["le.py"][0] == got["be.py"][0] == "é" and got["e.py"] == ("", "indexed", "utf8")
    assert got["odd.py"][1:] == ("failed_preserved", "odd_utf16") and got["bad.py"][1:] == ("failed_preserved", "invalid_utf8") and got["x.bin"][1] == "unsupported"
    assert df.select(decode_status(F.col("content")).alias("s")).count() == len(rows)


def test_tokens_of_very_long_strings(spark):
    """A quote that spans a megabyte, closed or not, with escapes throughout, is one token and overflows no stack."""
    rows = [('"' + "a\\n" * 300_000 + '"',), ("'" + "b" * 1_000_000,), ("x = 'it' + \"q\\\"\"",)]
    df = spark.createDataFrame(rows, "t string").select(F.transform(text.body_tokens(F.col("t")), F.length).alias("n"))
    assert [r.n for r in df.collect()] == [[900_002], [1, 1_000_000], [1, 1, 4, 1, 5]]
