"""Markdown outlines: headings, sections, parents, anchors, links and fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.functions.text import slug
from strataloom.operators.spans import line_offsets


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """ATX headings outside fences: ``key, line, start_byte, level, title``."""
    ls = line_offsets(docs.select(key, text), text, key)
    fence = F.col("line_text").rlike(r"^ {0,3}(```|~~~)").cast("int")
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    ls = ls.withColumn("fences", F.sum(fence).over(w))
    hit = ls.where((F.col("fences") % 2 == 0) & F.col("line_text").rlike(r"^ {0,3}#{1,6}([ \t]|\r?$)"))
    return hit.select(
        key, "line", "start_byte", F.length(F.regexp_extract("line_text", r"^ {0,3}(#{1,6})", 1)).cast("long").alias("level"),
        F.trim(F.regexp_replace(F.regexp_extract("line_text", r"^ {0,3}#{1,6}[ \t]*([^\r]*)", 1), r"[ \t]+#+[ \t]*$", "")).alias("title"),
    )


def sections(found: DataFrame, key: str) -> DataFrame:
    """Adds ``section_end`` (line of the next heading of the same or a higher level) and ``parent_line``.

    Levels are at most six, so both are minima over six running values, not a self-join.
    """
    ahead = W.partitionBy(key).orderBy("line").rowsBetween(1, W.unboundedFollowing)
    back = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    ends = [F.min(F.when(F.col("level") <= n, F.col("line"))).over(ahead) for n in range(1, 7)]
    ups = [F.max(F.when(F.col("level") < n, F.col("line"))).over(back) for n in range(1, 7)]
    out = found
    for i in range(6):
        out = out.withColumn(f"__e{i + 1}", ends[i]).withColumn(f"__u{i + 1}", ups[i])
    end = F.coalesce(*[F.when(F.col("level") == i, F.col(f"__e{i}")) for i in range(1, 7)])
    up = F.coalesce(*[F.when(F.col("level") == i, F.col(f"__u{i}")) for i in range(1, 7)])
    return out.select(*found.columns, end.alias("section_end"), up.alias("parent_line"))


def anchors(found: DataFrame, key: str) -> DataFrame:
    """Adds ``anchor``: the title's slug, with ``-1``, ``-2`` for repeats in the document."""
    s = found.withColumn("slug", slug(F.col("title")))
    n = F.row_number().over(W.partitionBy(key, "slug").orderBy("line")) - 1
    return s.withColumn("n", n).select(*found.columns, F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("n").cast("string"))).alias("anchor"))


def links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Inline links: ``key, ordinal, label, target``."""
    pattern = r"(?<!!)\[([^\]\[]*)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)"
    both = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("target")
    )
    return docs.select(key, F.posexplode(both).alias("ordinal", "l")).select(key, F.col("ordinal").cast("long").alias("ordinal"), "l.label", "l.target")
