"""Parent-child links to full hierarchies (roots, depths, paths, descendants, cycles).

Weighted disjoint-set forests: links are brought together by a locality hint (a rebalance, so AQE splits hot
localities) and each task unites the nodes of its links (by rank, with offsets and path compression) into
``node -> (local top, outside parent, offset)``. The contracted forests are merged over their entry nodes alone: one
more disjoint-set forest where the open ones fit a task's bound, pointer doubling until they do. Paths are read off
the parents' index, piece by piece. Correctness never depends on the locality: links that fall apart only mean more
entries to merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut

LOCAL = "node string, top string, next string, off long, cyclic boolean, lost boolean, path array<string>, below long"
ENTRY = "node string, top string, next string, off long, cyclic boolean, lost boolean, path array<string>"


class Forest:
    """A weighted disjoint-set forest of child-parent links.

    A set is a connected piece of the hierarchy. Each element keeps its offset, in parent steps, to its set's
    representative, and the representative the set's top: the element whose parent is not linked. Sets are united by
    rank, whichever side the top is on, and finds compress paths.
    """

    def __init__(self, n: int):
        self.up = list(range(n))
        self.gap = [0] * n  # offset to ``up``
        self.rank = [0] * n
        self.top = list(range(n))  # of a representative's set
        self.high = [0] * n  # the top's offset to the representative
        self.closed: list[int | None] = [None] * n  # the element whose link closed a cycle

    def find(self, x: int) -> tuple[int, int]:
        """The representative of an element's set and the element's offset to it."""
        trail = []
        while self.up[x] != x:
            trail.append(x)
            x = self.up[x]
        total = 0
        for y in reversed(trail):
            total += self.gap[y]
            self.up[y], self.gap[y] = x, total
        return x, total

    def link(self, child: int, parent: int, steps: int) -> None:
        """Puts a set's top below an element, ``steps`` parent steps away; within one set this closes a cycle."""
        c, at = self.find(child)
        p, off = self.find(parent)
        if c == p:
            self.closed[c] = child
        elif self.rank[p] >= self.rank[c]:
            self.up[c], self.gap[c] = p, off + steps - at
            self.rank[p] += self.rank[p] == self.rank[c]
        else:
            self.up[p], self.gap[p] = c, at - steps - off
            self.top[c], self.high[c], self.closed[c] = self.top[p], self.high[p] + self.gap[p], self.closed[p]


def contract(nodes: list[str], parents: list[str | None], steps: list[int] | None = None) -> list[tuple]:
    """Each node's ``(top, outside parent of the top, offset to the top, cyclic, lost)`` over some links.

    ``nodes`` are distinct. ``cyclic``: the node is its own ancestor. ``lost``: its chain ends in a cycle.
    """
    at = {n: i for i, n in enumerate(nodes)}
    sets = Forest(len(nodes))
    for i, p in enumerate(parents):
        if p is not None and p in at:
            sets.link(i, at[p], steps[i] if steps else 1)
    cyclic = [False] * len(nodes)
    for x in {c for c in sets.closed if c is not None}:
        while not cyclic[x]:
            cyclic[x] = True
            x = at[parents[x]]
    out = []
    for i in range(len(nodes)):
        r, off = sets.find(i)
        if sets.closed[r] is not None:
            out.append((None, None, 0, cyclic[i], True))
        else:
            t = sets.top[r]
            out.append((nodes[t], parents[t], off - sets.high[r], False, False))
    return out


def _local(with_path: bool, chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LOCAL.split(", ")]
        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= chunk:
                yield pd.DataFrame(_rows(held, with_path), columns=names)
                held, n = [], 0
        if n:
            yield pd.DataFrame(_rows(held, with_path), columns=names)

    return run


def _rows(held: list[pd.DataFrame], with_path: bool) -> list[tuple]:
    pdf = pd.concat(held) if len(held) > 1 else held[0]
    nodes = pdf["node"].tolist()
    parents = [None if p is None or p != p else p for p in pdf["parent"].tolist()]
    found = contract(nodes, parents)
    paths: dict[str, list[str]] = {}
    below = dict.fromkeys(nodes, 0)
    if with_path:
        order = sorted((i for i in range(len(nodes)) if not found[i][4]), key=lambda i: found[i][2])
        for i in order:  # parents come before their children
            paths[nodes[i]] = [*paths[parents[i]], nodes[i]] if found[i][2] else [nodes[i]]
        for i in reversed(order):
            if found[i][2]:
                below[parents[i]] += below[nodes[i]] + 1
    return [(n, *f, paths.get(n), None if f[4] else below[n]) for n, f in zip(nodes, found)]


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The open entries and those they lead to, all in one forest: every open one is resolved."""
    held = list(batches)
    if not held:
        return
    pdf = pd.concat(held) if len(held) > 1 else held[0]
    rows = {r[0]: r for r in pdf.itertuples(index=False, name=None)}
    nodes = list(rows)
    nexts = [None if rows[n][2] is None or rows[n][2] != rows[n][2] else rows[n][2] for n in nodes]
    found = contract(nodes, nexts, [rows[n][3] + 1 for n in nodes])
    at = {n: i for i, n in enumerate(nodes)}
    paths: dict[str, list[str] | None] = {}
    for i in sorted((i for i in range(len(nodes)) if not found[i][4]), key=lambda i: found[i][2]):
        own = rows[nodes[i]][6]
        own = None if own is None else list(own)
        above = nexts[i] if nexts[i] in at else None
        paths[nodes[i]] = own if above is None or own is None or paths[above] is None else paths[above] + own
    out = []
    for n, (top, _, off, _, lost) in zip(nodes, found):
        end = rows[top] if top is not None else None
        lost = lost or bool(end[5])
        out.append((n, None if lost else end[1], None, 0 if lost else off + end[3], rows[n][4], lost, None if lost else paths[n]))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in ENTRY.split(", ")])


def on_cycles(links: DataFrame) -> DataFrame:
    """The nodes of ``links(node, parent)`` that are their own ancestors.

    The links must form a functional graph. The image of the whole set under 2^k parent steps shrinks to
    exactly the cycles' nodes; the steps double until the image no longer shrinks.
    """
    known = links.select("node").distinct()
    step = cut(links.join(known.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent"))
    size = -1
    while True:
        image = cut(step.select(F.col("parent").alias("node")).distinct())
        now = image.count()
        if now == size or now == 0:
            return image
        size = now
        hop = step.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        step = cut(step.join(hop, "parent").select("node", F.col("up").alias("parent")))


def resolve(
    df: DataFrame,
    node: str,
    parent: str,
    locality: str | None = None,
    with_path: bool = True,
    chunk: int = 250_000,
    with_counts: bool = False,
) -> DataFrame:
    """Every node's root, depth, path and cycle flags.

    Columns: ``node_id, parent_id`` (strings), ``root_id`` and ``depth`` (a root has depth 0; null where the chain
    ends in a cycle), ``path`` (root first, the node last; null likewise, or without ``with_path``), ``in_cycle``
    (the node is its own ancestor, self-parents included) and ``below_cycle``. ``with_counts`` (and ``with_path``)
    adds ``n_descendants``: 0 for leaves, null where the chain ends in a cycle.

    Rows with a null node are not nodes. A parent that does not exist makes its child a root. Repeated rows count
    once; of several different parents of one node the smallest non-null one counts. Other columns of the input
    are ignored, whatever their names. An empty input gives an empty result. ``chunk`` bounds the links a task
    holds at once and changes no result.
    """
    n, p = F.col(f"`{node}`").cast("string"), F.col(f"`{parent}`").cast("string")
    loc = F.col(f"`{locality}`").cast("string") if locality else n
    links = (
        df.select(n.alias("node"), p.alias("parent"), loc.alias("loc"))
        .where("node is not null")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"), F.min("loc").alias("loc"))
    )
    local = links.hint("rebalance", "loc").select("node", "parent").mapInPandas(_local(with_path, chunk), LOCAL)
    local = cut(local)
    outside = local.where("next is not null").select(F.col("next").alias("node")).distinct()
    entries = cut(local.drop("below").join(outside, "node", "left_semi"))
    if entries.isEmpty():
        return _final(local, None, df, node, parent, with_counts)
    entries = _merged(entries, chunk)
    return _final(local, entries, df, node, parent, with_counts)


def _merged(entries: DataFrame, chunk: int) -> DataFrame:
    """Entries with all that lies above them; what only goes round in circles is lost."""
    opened = F.col("next").isNotNull() & ~F.col("lost")
    pending, stalled = -1, False
    while True:
        now = entries.where(opened).count()
        if now == 0:
            return entries
        if now <= chunk:
            # the last forest: the open entries and the closed ones they lead to, at most twice ``chunk`` rows
            open_ = entries.where(opened)
            used = entries.where(~opened).join(open_.select(F.col("next").alias("node")).distinct(), "node", "left_semi")
            done = open_.unionByName(used).coalesce(1).mapInPandas(_merge, ENTRY)
            done = done.join(open_.select("node"), "node", "left_semi").select(*entries.columns)
            return cut(entries.where(~opened).unionByName(done))
        # the count stands still when everything that can finish has finished
        if now == pending and stalled:
            return entries.withColumn("lost", F.col("lost") | F.col("next").isNotNull())
        pending, stalled = now, now == pending
        t = entries.select(
            F.col("node").alias("next"), F.col("top").alias("t_top"), F.col("next").alias("t_next"),
            F.col("off").alias("t_off"), F.col("lost").alias("t_lost"), F.col("path").alias("t_path"),
        )
        hit = F.col("t_off").isNotNull()
        entries = cut(
            entries.join(t, "next", "left").select(
                "node",
                F.when(hit, F.col("t_top")).otherwise(F.col("top")).alias("top"),
                F.when(hit, F.col("t_next")).alias("next"),
                F.when(hit, F.col("off") + 1 + F.col("t_off")).otherwise(F.col("off")).alias("off"),
                "cyclic",
                F.when(hit, F.col("t_lost")).otherwise(F.col("lost")).alias("lost"),
                F.when(hit, F.concat("t_path", "path")).otherwise(F.col("path")).alias("path"),
            )
        )


def _final(local: DataFrame, entries: DataFrame | None, df: DataFrame, node: str, parent: str, with_counts: bool) -> DataFrame:
    out = local
    if entries is not None:
        e = entries.select(
            F.col("node").alias("next"), F.col("top").alias("e_top"), F.col("off").alias("e_off"),
            F.col("lost").alias("e_lost"), F.col("path").alias("e_path"),
        )
        hit = F.col("e_off").isNotNull()
        # what hangs on nothing outside its task is done, and its null links meet in no join
        out = local.where("next is not null").join(e.hint("merge"), "next", "left").select(
            "node",
            F.when(hit, F.col("e_top")).otherwise(F.col("top")).alias("top"),
            F.when(hit, F.col("off") + 1 + F.col("e_off")).otherwise(F.col("off")).alias("off"),
            "cyclic",
            (F.col("lost") | F.coalesce("e_lost", F.lit(False))).alias("lost"),
            F.when(hit, F.concat("e_path", "path")).otherwise(F.col("path")).alias("path"),
            # the top of a local forest that hangs below a node of another one
            (hit & (F.col("off") == 0)).alias("hangs"), "below",
        )
        done = local.where("next is null").select("node", "top", "off", "cyclic", "lost", "path", F.lit(False).alias("hangs"), "below")
        out = cut(done.unionByName(out))
        # cycles that no task held whole
        if not entries.where("lost and not cyclic").isEmpty():
            open_ = out.where("lost and not cyclic").select("node")
            raw = df.select(
                F.col(f"`{node}`").cast("string").alias("node"), F.col(f"`{parent}`").cast("string").alias("parent")
            ).where("node is not null")
            raw = raw.join(open_, "node", "left_semi").groupBy("node").agg(F.min("parent").alias("parent"))
            circles = on_cycles(raw).withColumn("circle", F.lit(True))
            out = out.join(circles, "node", "left").withColumn("cyclic", F.col("cyclic") | F.coalesce("circle", F.lit(False)))
        if with_counts:
            # a hanging forest counts whole for every node above its top: forests are walked, not nodes
            above = out.where("hangs and not lost").select((F.col("below") + 1).alias("size"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node"))
            out = out.join(above.groupBy("node").agg(F.sum("size").alias("more")), "node", "left")
            out = out.withColumn("below", F.col("below") + F.coalesce("more", F.lit(0)))
    fine = ~F.col("lost")
    cols = [
        F.col("node").alias("node_id"),
        F.when(fine, F.col("top")).alias("root_id"),
        F.when(fine, F.col("off")).alias("depth"),
        F.when(fine, F.col("path")).alias("path"),
        F.col("cyclic").alias("in_cycle"),
        (F.col("lost") & ~F.col("cyclic")).alias("below_cycle"),
    ]
    return out.select(*cols, F.when(fine, F.col("below")).alias("n_descendants")) if with_counts else out.select(*cols)


def closure(resolved: DataFrame) -> DataFrame:
    """All descendants: ``ancestor_id, descendant_id, distance`` (at least 1), read off the paths."""
    return resolved.where("path is not null and depth > 0").select(
        F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id")
    ).where("at < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
