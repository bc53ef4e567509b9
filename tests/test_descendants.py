"""The descendants of both tables on a small fixture, against walking the parents."""

from strataloom.plans import registry

SYMBOLS = [("a", None, "f"), ("b", "a", "f"), ("c", "b", "g"), ("c", "b", "g"), ("d", "gone", "f"), ("e", "d", "h"), ("x", "y", "f"), ("y", "x", "f"), ("z", "x", "f"), ("1", None, "f")]
REVISIONS = [(1, None, "r"), (2, 1, "r"), (3, 2, "s"), (4, 4, "r")]


def walked(links):
    parent = {str(n): None if p is None else str(p) for n, p, _ in links}
    out = set()
    for n in parent:
        x, chain = n, [n]
        while parent[x] in parent and parent[x] not in chain:
            x = parent[x]
            chain.append(x)
        if parent[x] not in chain:
            out |= {(a, n, i) for i, a in enumerate(chain) if i}
    return out


def test_both_tables(spark, tmp_path):
    spark.createDataFrame(SYMBOLS, "symbol_id string, parent_symbol_id string, file_id string").write.parquet(f"{tmp_path}/symbols.parquet")
    spark.createDataFrame(REVISIONS, "revision_id long, parent_revision_id long, input_root string").write.parquet(f"{tmp_path}/extraction_revisions.parquet")
    got = [tuple(r) for r in registry.queries()["p4_descendants"](spark, str(tmp_path)).collect()]
    want = {("symbols", *p) for p in walked(SYMBOLS)} | {("extraction_revisions", *p) for p in walked(REVISIONS)}
    assert len(got) == len(want) and set(got) == want
    assert ("symbols", "a", "c", 2) in want
