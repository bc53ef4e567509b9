import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.operators import hierarchy


def brute(links):
    """root, depth, path, cyclic, lost of each node by walking."""
    parent = {}
    for n, p in links:
        if n is not None:
            old = parent.get(n)
            parent[n] = p if old is None else old if p is None else min(old, p)
    out = {}
    for n in parent:
        seen, path, x = {n}, [n], n
        cyc = lost = False
        while parent[x] is not None and parent[x] in parent:
            x = parent[x]
            if x == n:
                cyc = lost = True
                break
            if x in seen:
                lost = True
                break
            seen.add(x)
            path.append(x)
        out[n] = (None, None, None, cyc, lost and not cyc) if lost else (x, len(path) - 1, tuple(reversed(path)), False, False)
    return out


def check(spark, links, chunk, loc=None):
    rows = [(a, b, (a or "x")[-1:] if loc is None else loc) for a, b in links]
    df = spark.createDataFrame(rows, "id string, up string, loc string")
    rows = hierarchy.resolve(df, "id", "up", "loc", chunk=chunk, with_counts=True).collect()
    want = brute(links)
    assert {r.node_id: (r.root_id, r.depth, tuple(r.path) if r.path else None, r.in_cycle, r.below_cycle) for r in rows} == want
    below = Counter(a for w in want.values() if w[2] for a in w[2][:-1])
    assert {r.node_id: r.n_descendants for r in rows} == {n: None if w[2] is None else below[n] for n, w in want.items()}


def test_small(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("s", "s"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "x"), (None, "a"), ("b", "a")]
    check(spark, links, 1000)


def test_split_everywhere(spark):
    """Chunks of two links: chains and a long cycle are merged from pieces."""
    links = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [(f"c{i}", f"c{(i + 1) % 17}") for i in range(17)] + [("tail", "c3"), ("tail2", "tail")]
    for chunk in (2, 30):  # pointer doubling alone, and a last forest
        check(spark, links, chunk)


def test_random(spark):
    rng = random.Random(3)
    names = [f"v{i}" for i in range(60)]
    for chunk in (3, 1000):
        links = [(n, rng.choice([*names, None, "absent"])) for n in names]
        check(spark, links, chunk)


def test_several_parents_and_empty(spark):
    check(spark, [("a", "c"), ("a", "b"), ("b", None), ("c", None), ("a", None)], 1000)
    assert hierarchy.resolve(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0


def test_clashing_columns_and_numbers(spark):
    df = spark.createDataFrame([(1, None, "u", "v"), (2, 1, "u", "v"), (3, 2, None, None)], "node long, parent long, root_id string, path string")
    got = {r.node_id: r.depth for r in hierarchy.resolve(df, "node", "parent").collect()}
    assert got == {"1": 0, "2": 1, "3": 2}


def test_deep_chain_needs_no_recursion(spark):
    n = 20_000
    rows = hierarchy.contract([str(i) for i in range(n)], [None, *(str(i) for i in range(n - 1))])
    assert max(r[2] for r in rows) == n - 1


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, up string")
    out = {r.node_id: r.n_descendants for r in hierarchy.resolve(df, "id", "up", with_counts=True).collect()}
    assert out == {"a": 3, "b": 1, "c": 0, "d": 0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.one_of(st.none(), st.integers(0, 11))), max_size=12, unique_by=lambda t: t[0]))
def test_contract_alone(links):
    nodes, parents = [str(a) for a, _ in links], [None if b is None else str(b) for _, b in links]
    want = brute(list(zip(nodes, parents)))
    for node, (top, nxt, off, cyclic, lost) in zip(nodes, hierarchy.contract(nodes, parents)):
        root, depth, p, c, below = want[node]
        assert (cyclic, lost and not cyclic) == (c, below)
        if not lost:
            assert (top, off) == (root, depth)


def test_a_forest_with_weights_keeps_offsets_on_either_side():
    """Chains are linked from the middle outwards, so ranks put tops below bottoms."""
    rng = random.Random(1)
    n = 300
    nodes = [f"n{i}" for i in range(n)]
    parents: list = [None] * n
    steps = [rng.randint(1, 9) for _ in range(n)]
    for i in range(1, n):
        parents[i] = nodes[rng.randrange(i)]
    order = list(range(n))
    rng.shuffle(order)
    got = hierarchy.contract([nodes[i] for i in order], [parents[i] for i in order], [steps[i] for i in order])
    off = {nodes[i]: g[2] for i, g in zip(order, got)}
    for i in range(1, n):
        assert off[nodes[i]] == off[parents[i]] + steps[i]
    assert off["n0"] == 0 and {g[0] for g in got} == {"n0"}
