"""Joins on spans: containment (innermost), nearest following or preceding, lines of a span.

Spans are half-open byte intervals of one file. Both sides are cut into bins of ``BIN`` bytes, so the join is an
equi-join on (file, bin) that a hot file spreads over; the innermost container is then a window-free minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 4096

# Ranks of symbol kinds when several contain a position.
KIND_RANK = {
    "function": 1, "method": 1, "constructor": 1, "destructor": 1, "operator": 1, "delegate": 1, "event": 1,
    "class": 2, "interface": 2, "struct": 2, "enum": 2, "trait": 2, "union": 2, "type": 2,
    "namespace": 3, "module": 3,
    "variable": 10, "constant": 10, "property": 10, "field": 10, "enum_member": 10,
}


def kind_rank(kind: Column) -> Column:
    out = F.lit(5)
    for rank in (1, 2, 3, 10):
        out = F.when(kind.isin([k for k, r in KIND_RANK.items() if r == rank]), rank).otherwise(out)
    return out


def containing(probes: DataFrame, spans: DataFrame, key: str, point: str, exclude_start: bool = False) -> DataFrame:
    """Each probe's innermost span: ``key, container_id`` (null without one), one row per probe.

    ``probes`` has key, file_id and a byte position; ``spans`` symbol_id, file_id, kind, start_byte, end_byte. A span
    contains the positions from its start to before its end. Of several the best kind rank wins, then the
    shortest, the first to start and the smallest id. ``exclude_start`` leaves out spans that start at the probe
    (a declaration does not contain itself). Probes with null position have no container.
    """
    p = probes.select(F.col(key).alias("probe"), "file_id", F.col(point).alias("at"))
    s = spans.where("start_byte < end_byte").select(
        F.col("symbol_id").alias("container_id"), "file_id", "start_byte", "end_byte", kind_rank(F.col("kind")).alias("rank"),
        F.explode(F.sequence(F.floor(F.col("start_byte") / BIN), F.floor((F.col("end_byte") - 1) / BIN))).alias("bin"),
    )
    inside = (F.col("start_byte") < F.col("at")) if exclude_start else (F.col("start_byte") <= F.col("at"))
    hits = (
        p.withColumn("bin", F.floor(F.col("at") / BIN))
        .join(s, ["file_id", "bin"])
        .where(inside & (F.col("at") < F.col("end_byte")))
        .groupBy("probe")
        .agg(F.min(F.struct("rank", (F.col("end_byte") - F.col("start_byte")).alias("size"), "start_byte", "container_id")).alias("best"))
    )
    return p.select("probe").join(hits, "probe", "left").select(F.col("probe").alias(key), F.col("best.container_id").alias("container_id"))


def nearest(probes: DataFrame, targets: DataFrame, key: str, point: str, target_id: str, target_point: str, following: bool = True) -> DataFrame:
    """As-of join: each probe's nearest target in its file, at or after it (or at or before it).

    One sort of both sides together by (file, position): a running last value carries the target along, so
    there is no pairwise comparison however many rows a file has. Ties go to the smallest target id. Result:
    ``key, target_id`` (null without one) for every probe; null positions have none.
    """
    from pyspark.sql import Window as W

    p = probes.select("file_id", F.col(point).alias("at"), F.col(key).alias("probe"), F.lit(None).cast("string").alias("target"))
    t = (
        targets.where(F.col(target_point).isNotNull()).groupBy("file_id", F.col(target_point).alias("at"))
        .agg(F.min(target_id).cast("string").alias("target"))
        .select("file_id", "at", F.lit(None).cast(probes.schema[key].dataType).alias("probe"), "target")
    )
    order = F.col("at").desc() if following else F.col("at").asc()
    w = W.partitionBy("file_id").orderBy(order, F.col("probe").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    both = p.where("at is not null").unionByName(t)
    got = both.withColumn("target", F.last("target", ignorenulls=True).over(w)).where("probe is not null").select("probe", "target")
    return p.select("probe").join(got, "probe", "left").select(F.col("probe").alias(key), F.col("target").alias("target_id"))


def lines(df: DataFrame, text: str) -> DataFrame:
    """Each line of a text with its number (from 1), content without its break, and length in bytes with it.

    Adds ``line, line_text, line_bytes``. A trailing newline starts no further line; empty and null texts have none.
    """
    parts = F.split(F.col(text), "\n", -1)
    parts = F.when(F.endswith(F.col(text), F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    offsets = F.transform(parts, lambda x: F.octet_length(x).cast("long") + 1)
    exploded = df.where(F.col(text) != "").select("*", F.posexplode(F.arrays_zip(parts.alias("t"), offsets.alias("n"))).alias("i", "r"))
    return exploded.select(*df.columns, (F.col("i") + 1).cast("long").alias("line"), F.col("r.t").alias("line_text"), F.col("r.n").alias("line_bytes"))


def line_offsets(df: DataFrame, text: str, key: str) -> DataFrame:
    """``lines`` with ``start_byte``, the running sum of the lengths of the lines before."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines(df, text).withColumn("start_byte", F.coalesce(F.sum("line_bytes").over(w), F.lit(0)).cast("long")).drop("line_bytes")
