"""Same shapes of two characters that are both not ASCII."""

import unicodedata

import pytest

from strataloom.llm import lookalikes

GROUPS = ["ПΠ∏", "ГΓ", "ФΦ", "µμ", "∆Δ", "∑Σ", "ѰΨ", "ӘƏ", "ӨѲƟ", "ӔÆ", "ℵא", "ИͶ"]
APART = ["Ππ", "Пп", "ГΓ́", "Фφ", "Ии", "ИЙ", "μu", "ΔA", "ΣE", "Æa", "Λл"]


def form(con, t):
    return con.execute(lookalikes.form_select("(SELECT CAST(? AS VARCHAR) AS x)", (), "x"), [t]).fetchone()[0]


@pytest.fixture(scope="module")
def con():
    return pytest.importorskip("duckdb").connect()


@pytest.mark.parametrize("group", GROUPS)
def test_same(con, group):
    assert len(set(group)) == len(group) > 1 and len({form(con, f"x{c}y") for c in group}) == 1


@pytest.mark.parametrize("group", APART)
def test_different(con, group):
    assert form(con, group[0]) != form(con, group[1:])


def test_accents_and_stability(con):
    assert form(con, "Ѓ") == form(con, "Γ́") == form(con, "Ѓ") and form(con, "Ə̈") == form(con, "Ӛ")
    a, b = lookalikes.tables()
    assert len(a) == len(b) == len(set(a)) and not set("".join(lookalikes.mapping().values())) & set(lookalikes.mapping())
    for c in lookalikes.LOOK_OTHER:
        assert form(con, form(con, c)) == form(con, c) and unicodedata.normalize("NFC", c) == c


def test_pairs(spark):
    df = spark.createDataFrame([(1, "5 µm"), (2, "5 μm"), (3, "5 um"), (4, "ПГФ"), (5, "ΠΓΦ"), (6, "πγφ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in lookalikes.same_look_pairs(df, "doc_id", "text").collect()) == [(1, 2), (4, 5)]
