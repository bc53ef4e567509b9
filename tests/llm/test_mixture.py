import random

import pytest

from strataloom.llm import mixture

SIZES = "doc_id long, source string, tokens long, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def make(spark, sizes, targets):
    return spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS)


def report(spark, sizes, targets, **kw):
    s, t = make(spark, sizes, targets)
    drawn = mixture.draw(s, t, **kw)
    return {r.doc_id: r.copies for r in drawn.collect()}, {r.source: r for r in mixture.shares(drawn, s, t, **kw).collect()}


def test_budgets_are_met_within_a_document(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice("abc") if i % 3 else "a", rng.randint(1, 90), None) for i in range(4000)]
    _, r = report(spark, sizes, [("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.5, 3)], total=150_000)
    for x in r.values():
        assert x.met and abs(x.budget - x.drawn_tokens) == abs(x.open_tokens) <= 45 and x.most_copies <= x.max_repeats


def test_the_total_is_the_largest_at_which_all_shares_are_reached(spark):
    sizes = [(i, "big", 10, None) for i in range(1000)] + [(2000 + i, "small", 10, None) for i in range(20)]
    drawn, r = report(spark, sizes, [("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1)])
    # small holds 200 tokens, three times; 600 are 0.4 of 1500
    assert r["small"].drawn_tokens == 600 and r["big"].drawn_tokens == 900
    assert abs(r["small"].reached_share - 0.4) < 1e-9 and r["small"].met and r["big"].met
    assert set(drawn.values()) == {1, 3}


def test_a_missed_share_is_told(spark):
    sizes = [(1, "tiny", 10, None), (2, "tiny", 10, None)] + [(i, "big", 10, None) for i in range(10, 210)]
    drawn, r = report(spark, sizes, [("tiny", 0.5, 3), ("big", 0.5, 5), ("none", 0.1, 2)], total=1000)
    assert drawn[1] == drawn[2] == 3 and not r["tiny"].met and r["tiny"].drawn_tokens == 60
    # its budget is filled, but its share of what was drawn is far above the target
    assert r["big"].drawn_tokens == 500 and r["big"].most_copies == 1 and not r["big"].met
    assert not r["none"].met and r["none"].drawn_tokens == 0 and r["none"].open_tokens == 100
    assert abs(sum(x.reached_share for x in r.values()) - 1) < 1e-9


def test_a_huge_document_does_not_end_the_draw(spark):
    sizes = [(i, "a", 10, None) for i in range(300)] + [(1000 + i, "a", 5000, None) for i in range(3)]
    _, r = report(spark, sizes, [("a", 1.0, 1)], total=2000)
    assert abs(r["a"].drawn_tokens - 2000) <= 5


@pytest.mark.parametrize("seed", range(3))
def test_thresholds_are_nested_for_unequal_sizes(spark, seed):
    rng = random.Random(seed)
    sizes = [(i, "a", int(rng.paretovariate(0.7)), None) for i in range(600)]
    whole = sum(s[2] for s in sizes)
    last: set = set()
    for part in (0.05, 0.1, 0.3, 0.31, 0.6, 0.95):
        drawn, _ = report(spark, sizes, [("a", 1.0, 1)], total=int(whole * part))
        assert last <= set(drawn)
        last = set(drawn)


def test_a_large_document_with_the_lowest_hash_drives_none_out(spark):
    for big in range(200, 206):
        sizes = [(i, "a", 1, None) for i in range(199)] + [(big, "a", 100, None)]
        small, r = report(spark, sizes, [("a", 1.0, 1)], total=50)
        large, _ = report(spark, sizes, [("a", 1.0, 1)], total=100)
        assert r["a"].drawn_tokens == 50 and set(small) < set(large)


def test_against_a_plain_walk(spark):
    """The histograms find the prefix that a walk along the sorted places finds."""
    rng = random.Random(9)
    sizes = [(i, "a", rng.choice([1, 3, 50, 400]), None) for i in range(500)]
    s, t = make(spark, sizes, [("a", 1.0, 2)])
    whole = sum(x[2] for x in sizes)
    for total in (whole // 7, whole // 2, whole + 11):
        b = mixture.budgets(s, t, total)
        order = sorted((r.h, r.doc_id, r.tokens) for r in mixture.placed(s, b, "doc_id").collect())
        assert all(0 <= h < 1 << 60 for h, _, _ in order)
        left, walked = total % whole, set()
        for _, i, n in order:
            if n > left:
                if n < 2 * left:
                    walked.add(i)
                break
            walked.add(i)
            left -= n
        drawn = {r.doc_id: r.copies for r in mixture.draw(s, t, total=total).collect()}
        base = total // whole
        assert {i for i, c in drawn.items() if c == base + 1} == walked


def test_nulls_ties_and_empty(spark):
    sizes = [(1, None, 10, None), (2, "a", None, None), (3, "a", 0, None), (4, "a", 5, None), (5, "other", 5, None), (None, "a", 5, None)]
    drawn, r = report(spark, sizes, [("a", 0.5, 2), ("a", 0.5, 2), (None, 0.5, 1), ("b", None, None)], total=20)
    assert set(drawn) == {4, None} and drawn[4] == 1
    drawn, r = report(spark, [], [("a", 1.0, 1)])
    assert drawn == {} and r["a"].drawn_tokens == 0
    drawn, r = report(spark, sizes, [])
    assert drawn == {} and r == {}
