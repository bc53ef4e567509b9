import unicodedata

import pytest

from strataloom.llm import lookalikes

SAME = [
    ("ＡＢＣ　１２！", "ABC 12!"), ("é", "é"), ("x​y﻿", "xy"), ("a b c", "a b c"), ("раураl", "paypal"), ("Κ", "K"), ("K", "K"), ("Å", "Å"),
    ("ё", "ë"), ("ｶﾞ", "ガ"), ("ệ", "ệ"), ("각", "각"), ("a­b", "ab"), ("ｅ́", "é"), ("‮abc‬", "abc"), ("line\r\nx", "line\nx"),
    ("a\rb", "a\nb"), ("a\u3164b", "ab"), ("a\uffa0b", "ab"), ("oﬃce", "office"), ("𝒜𝐛", "Ab"), ("ℝ", "R"), ("α", "a"), ("ρ", "p"), ("ά", "á"), ("\u1f00", "\u03b1\u0313"), ("\u1f40", "\u03bf\u0313"), ("Ⅷ", "VIII"), ("ǆ", "dž"),
]
OTHER = [("a", "A"), ("l", "1"), ("e", "é"), ("2", "²"), ("a b", "a  b"), ("a", "a "), ("I", "l"), ("O", "0"), ("rn", "m"), ("👩‍💻", "👩💻"), ("и", "й"), ("-", "–"), ("a\rb", "ab"), ("ſ", "s"), ("①", "1"), ("½", "1/2"), ("ₐ", "a"), ("ϑ", "θ")]


def form(con, t):
    return con.execute(lookalikes.form_select("(SELECT CAST(? AS VARCHAR) AS x)", (), "x"), [t]).fetchone()[0]


@pytest.fixture(scope="module")
def con():
    return pytest.importorskip("duckdb").connect()


@pytest.mark.parametrize("a,b", SAME)
def test_same(con, a, b):
    assert a != b and form(con, a) == form(con, b)


@pytest.mark.parametrize("a,b", OTHER)
def test_different(con, a, b):
    assert form(con, a) != form(con, b)


def test_ascii_is_fixed_and_the_form_is_stable(con):
    text = "".join(map(chr, range(32, 127))) + "\n\t"
    assert form(con, text) == text
    for a, _ in SAME:
        assert form(con, form(con, a)) == form(con, a)
    assert form(con, None) is None and form(con, "") == ""


def test_pairs_and_edges(spark):
    big = "word " * 60_000
    rows = [(1, "abc", "t"), (2, "аbc", "t"), (3, "abc", "t"), (4, "ab​c", "t"), (5, None, "t"), (6, "", "t"), (7, "​", "t"), (8, " ", "t"), (9, " ", "t"),
            (10, big, "t"), (11, big.replace(" ", " ", 1), "t"), (None, "aｂc", "t"), (12, "Abc", "t"), (1, "abc", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted(tuple(r) for r in lookalikes.same_look_pairs(df, "doc_id", "text").collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)]
    assert lookalikes.same_look_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert lookalikes.forms(df, "doc_id", "text").count() == len(rows)


def look(text):
    """Character by character, from Unicode's data and the documented look-alikes alone."""
    out, held = [], {0x3164, 0xFFA0, 0x115F, 0x1160, 0x34F, 0x61C, 0x17B4, 0x17B5}
    text = text.replace("\r\n", "\n")
    picture = lambda c: 0x2190 <= ord(c) <= 0x2BFF or 0x1F000 <= ord(c) <= 0x1FAFF
    for i, c in enumerate(text):
        kind, cp = unicodedata.category(c), ord(c)
        if c in "\r\x85\u2028\u2029":
            out.append("\n")
        elif kind == "Zs" or cp == 0x2800:
            out.append(" ")
        elif c == "\u200d" and 0 < i < len(text) - 1 and picture(text[i + 1]) and (picture(text[i - 1]) or text[i - 1] == "\ufe0f"):
            out.append(c)
        elif (kind in ("Cf", "Cc") and c not in "\n\t\x0b\x0c" and not 0x600 <= cp <= 0x8FF) or cp in held or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF:
            continue
        else:
            out.append(c)
    once = unicodedata.normalize("NFC", "".join(out))
    done = []
    for c in once:
        parts = unicodedata.normalize("NFD", c)
        if any(p in lookalikes.LOOK or p in lookalikes.LOOK_OTHER for p in parts):
            done += [lookalikes.LOOK.get(p, lookalikes.LOOK_OTHER.get(p, p)) for p in parts]
            continue
        d = unicodedata.decomposition(c).split()
        if d and (d[0] in ("<wide>", "<narrow>", "<font>") or (d[0] == "<compat>" and ord(c) in lookalikes.LETTER_COMPOUNDS)):
            c = "".join(chr(int(x, 16)) for x in d[1:])
            c = "".join(lookalikes.LOOK.get(p, lookalikes.LOOK_OTHER.get(p, p)) for p in c)
        done.append(c)
    return unicodedata.normalize("NFC", "".join(done))


def test_pairs_of_the_test_data_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    groups = {}
    for i, t in docs:
        form = look(t)
        if form.strip():
            groups.setdefault(form, []).append((i, t))
    want = {(min(i, j), max(i, j)) for g in groups.values() for i, t in g for j, u in g if i < j and t != u}
    got = lookalikes.same_look_pairs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text").collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_a_class_of_many_spellings(spark):
    """More spellings than one piece holds: every pair comes once."""
    rows = [(n, "".join(c + ("\u200b" if n >> i & 1 else "") for i, c in enumerate("abcdefghijk"))) for n in range(2048)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lookalikes.same_look_pairs(df, "doc_id", "text")
    assert got.count() == got.distinct().count() == 2048 * 2047 // 2


def test_copies_do_not_meet_each_other(spark):
    """A hot class: many copies of one text and a single look-alike give one pair a copy."""
    rows = [(i, "same text") for i in range(3000)] + [(9999, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lookalikes.same_look_pairs(df, "doc_id", "text").count() == 3000
