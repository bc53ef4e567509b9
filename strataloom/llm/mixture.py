"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit place in its source: its hash, or, where it is large beside its source, a later one,
so that no prefix of the order is dominated by one document. A source's budget is a whole number of copies of all its
documents plus a rest; the rest is filled by the documents below a threshold. One histogram of tokens by source and
the place's leading bits finds the bucket in which each budget ends; only that bucket's documents (one in 4096) are
looked at again, by their next bits, so nothing is sorted. The order does not depend on the budget, hence thresholds
are nested: a larger budget keeps every document that a smaller one drew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.session import cut

BITS, LEVELS = 12, 5
#: A document waits until its source's drawn part is this many times its size, the largest for the last 2^-LATE of it.
WAIT, LATE = 8, 4


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: what it has and can give, its budget, whole copies and the rest.

    ``total`` is the size of the mixture in tokens; by default the largest one at which every source that can give
    anything reaches its share within ``max_repeats`` copies. Sources without documents (or without repeats) cannot
    bound it: they have a budget that stays open. Targets with null source are left out, repeated ones count once
    (the smallest share), a null or negative ``max_repeats`` means none.
    """
    t = targets.where("source is not null").groupBy("source").agg(
        F.min("target_share").alias("target_share"), F.greatest(F.coalesce(F.min("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats")
    )
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    b = t.join(have, "source", "left").na.fill(0, ["available", "documents"])
    b = b.withColumn("capacity", F.col("available") * F.col("max_repeats"))
    # one row for each target, so the window over all of them is small
    reach = F.min(F.when((F.col("capacity") > 0) & (F.col("target_share") > 0), F.col("capacity") / F.col("target_share"))).over(W.partitionBy())
    whole = F.lit(total).cast("double") if total is not None else reach
    b = b.withColumn("budget", F.coalesce(F.floor(whole * F.col("target_share") + 1e-6), F.lit(0)))
    copies = F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))
    b = b.withColumn("copies", F.when(F.col("available") > 0, copies).otherwise(0))
    rest = F.when(F.col("copies") < F.col("max_repeats"), F.col("budget") - F.col("copies") * F.col("available")).otherwise(0)
    return b.withColumn("rest", F.when(F.col("available") > 0, rest).otherwise(0).cast("long"))


def placed(sizes: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The documents of target sources with ``h``, their place in the source's order, and their source's plan.

    With ``g`` the part of the source that ``WAIT`` times the document makes up, a hash of at least ``g`` is the place
    itself and a smaller one goes to ``g`` plus the hash. Where ``g`` is above a half, all hashes go to the last
    2^-LATE. Places stay spread out and below 1.
    """
    top = BITS * LEVELS
    hash_ = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("mixture")), 64 - top)
    wait = F.col("tokens").cast("double") * WAIT / F.col("available")
    g = F.floor(F.least(wait, F.lit(0.5)) * float(1 << top)).cast("long")
    late = F.lit((1 << top) - (1 << (top - LATE))) + F.shiftright("h", LATE)
    out = sizes.join(F.broadcast(b.select("source", "available", "copies", "rest")), "source")
    return out.withColumn("h", hash_).withColumn("h", F.when(wait > 0.5, late).when(F.col("h") >= g, F.col("h")).otherwise(F.col("h") + g))


def _edges(hist: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Where each source's rest ends in its histogram: the bucket that does not fit whole, and what is left for it."""
    run = hist.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")))
    fit = run.join(F.broadcast(state.select("source", "left")), "source").groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("used"),
        F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", "tokens", "n"))).alias("edge"),
    )
    return state.join(fit, "source").select(
        "source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
        # without an edge all of the range fits: its end is the threshold
        F.coalesce(F.expr(f"low + shiftleft(edge.bucket, {shift})"), F.col("low") + F.lit(1 << (shift + BITS))).alias("low"),
        F.lit(1 << shift).alias("span"), F.coalesce("edge.tokens", F.lit(0)).alias("edge_tokens"), F.coalesce("edge.n", F.lit(0)).alias("edge_n"),
    )


def thresholds(docs: DataFrame, b: DataFrame) -> DataFrame:
    """Per source with a rest the place below which its documents are drawn once more: ``source, threshold, open``.

    ``docs`` as of ``placed``. The document on the boundary is drawn where that comes closer to the budget than
    leaving it; ``open`` is what then is missing (negative: over the budget). Documents of one place (the same 60
    bits) are drawn together.
    """
    state = b.where("rest > 0").select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("low"))
    shift = BITS * (LEVELS - 1)
    hist = docs.where("rest > 0").groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    state = cut(_edges(hist, state, shift))
    settled = state.where("edge_n <= 1")
    state = state.where("edge_n > 1")
    inner = None
    while shift and not state.isEmpty():
        at = F.broadcast(state.select("source", "low", "span"))
        inside = (docs.select("source", "tokens", "h") if inner is None else inner).join(at, "source").where("h >= low and h < low + span")
        inner = cut(inside.select("source", "tokens", "h"))
        shift -= BITS
        hist = inner.join(at, "source").groupBy("source", F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket"))
        state = cut(_edges(hist.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), state.select("source", "left", "low"), shift))
        settled = settled.unionByName(state.where("edge_n <= 1"))
        state = state.where("edge_n > 1")
    closer = F.col("edge_tokens") < 2 * F.col("left")
    return settled.unionByName(state).select(
        "source", F.when(closer, F.col("low") + F.col("span")).otherwise(F.col("low")).alias("threshold"),
        (F.col("left") - F.when(closer, F.col("edge_tokens")).otherwise(0)).alias("open"),
    )


def draw(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """Each drawn document and its number of copies: ``key, source, tokens, copies``.

    ``sizes`` has key, source and tokens. Documents without a source, without tokens or of a source without a target
    are not drawn. A source whose documents cannot fill its budget within ``max_repeats`` copies gives all it can; the
    others are not changed by that. Other columns are ignored, whatever their names. The targets are a small fixed
    table (one row a source); its size is checked.
    """
    if targets.limit(100_001).count() > 100_000:
        raise ValueError("more than 100,000 target sources")
    sizes = sizes.where("source is not null and tokens > 0").select(key, "source", "tokens")
    b = cut(budgets(sizes, targets, total))
    docs = placed(sizes, b, key)
    ends = cut(thresholds(docs, b))
    out = docs.join(F.broadcast(ends.select("source", "threshold")), "source", "left")
    copies = F.col("copies") + F.when(F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)), 1).otherwise(0)
    return out.select(key, "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None, tolerance: float = 0.005) -> DataFrame:
    """The report: per target source its budget, what was drawn, the reached share, and whether the target was met.

    ``share_of_budget`` sets the drawn tokens against the intended total, ``reached_share`` against the drawn total,
    ``open_tokens`` is what the budget misses (negative where the boundary document went over it). ``met``: the
    reached share is within ``tolerance`` of the target.
    """
    b = budgets(sizes.where("source is not null and tokens > 0"), targets, total)
    got = drawn.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"),
        F.count("*").alias("drawn_documents"),
    )
    out = b.join(got, "source", "left").na.fill(0, ["drawn_tokens", "most_copies", "drawn_documents"])
    all_drawn, all_budget = F.sum("drawn_tokens").over(W.partitionBy()), F.sum("budget").over(W.partitionBy())
    out = out.withColumn("reached_share", F.when(all_drawn > 0, F.col("drawn_tokens") / all_drawn))
    return out.select(
        "source", "target_share", "max_repeats", "documents", "available", "budget", "drawn_documents", "drawn_tokens", "most_copies",
        "reached_share", F.when(all_budget > 0, F.col("drawn_tokens") / all_budget).alias("share_of_budget"),
        (F.col("budget") - F.col("drawn_tokens")).alias("open_tokens"),
        F.coalesce(F.abs(F.col("reached_share") - F.col("target_share")) <= tolerance, F.lit(False)).alias("met"),
    )
