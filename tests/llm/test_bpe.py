import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
V = bpe.Vocabulary()
WANT = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=V.ranks, special_tokens={})
E = bpe.Encoder(V)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200), st.integers(1, 40))
def test_any_text_in_any_chunks(text, chunk):
    ids = E.encode(text, chunk)
    assert ids == WANT.encode_ordinary(text)
    assert bpe.Decoder(V).decode(ids) == text


@pytest.mark.parametrize("unit", ["a", "ab", "é", "🚀x", "1", " ", "\n ", "=-", "the ", "\t", "漢字", "<|endoftext|>"])
def test_long_runs_with_bounded_memory(unit):
    """Pieces far longer than what is held: equal ids, and the window never grows with the piece."""
    text = unit * 9000 + "x"
    assert E.encode(text, 1000) == WANT.encode_ordinary(text)
    t = bpe.Transducer(V)
    out = []
    for _ in range(300):
        out += t.feed(unit.encode() * 20)
        assert len(t.window) <= 4 * V.longest + 600
    out += t.finish()
    assert b"".join(V.tokens[i] for i in out) == unit.encode() * 6000


def test_the_lookahead_is_enforced(monkeypatch):
    assert V.bound == V.lookahead() == sum(len(t) > 1 for t in V.ranks) * V.longest
    monkeypatch.setattr(V, "bound", 0)
    with pytest.raises(ValueError):
        bpe.Transducer(V).feed(b"abc" * 3000)


def test_tokens_leave_before_the_end():
    t = bpe.Transducer(V)
    assert len(t.feed(b"abc" * 3000)) > 1000


def test_decoder_waits_for_whole_characters():
    d = bpe.Decoder(V)
    ids = WANT.encode_ordinary("a🚀漢")
    parts = [d.feed([i]) for i in ids]
    assert "".join(parts) + d.finish() == "a🚀漢" and any(p == "" for p in parts)


def test_merge_piece_is_the_same(capsys):
    rng = random.Random(1)
    for _ in range(300):
        p = bytes(rng.choice(b"abcde th.") for _ in range(rng.randint(1, 20)))
        t = bpe.Transducer(V)
        assert t.feed(p) + t.finish() == [V.ranks[x] for x in bpe.merge_piece(V.ranks, p)]
    assert V.lookahead() >= V.longest


def test_column(spark):
    rows = [(1, "hello world", "a"), (2, "", "b"), (3, None, "c"), (4, "<|endoftext|>", "d"), (None, "x y", "e"), (1, "hello world", "a"), (5, "z" * 200_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(((k, WANT.encode_ordinary(t) if t else []) for k, t, _ in rows), key=str)
    back = bpe.decode_column(bpe.encode_column(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
    n = {r.doc_id: r.tokens for r in bpe.count_column(df, ["doc_id"], "text").collect()}
    assert n[2] == n[3] == 0 and n[1] == 2
