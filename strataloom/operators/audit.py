"""Audits of an artifact: spans against bytes, registries against files, claims, gaps and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_text(content: Column, start: Column, end: Column) -> Column:
    """The text of a byte span of a content; null where the span does not lie in it or cuts a character."""
    raw = content.cast("binary")
    part = F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    return F.when((start >= 0) & (end >= start) & (end <= F.octet_length(content)) & F.is_valid_utf8(part), part)


def span_check(rows: DataFrame, snapshots: DataFrame, needle: str) -> DataFrame:
    """Whether each row's span holds its ``needle`` column's text: ``rows`` with ``verdict`` (holds, differs, outside, no_file).

    ``rows`` has file_id, start_byte and end_byte; ``snapshots`` file_id and content, one row a file.
    """
    both = rows.join(snapshots.select("file_id", "content"), "file_id", "left")
    text = span_text(F.col("content"), F.col("start_byte"), F.col("end_byte"))
    verdict = F.when(F.col("content").isNull(), "no_file").when(text.isNull(), "outside").when(F.contains(text, F.col(needle)), "holds").otherwise("differs")
    return both.withColumn("verdict", verdict).drop("content")


def reconcile(registry: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Entries without a file and files without an entry: ``key, side`` (missing, unlisted)."""
    a, b = registry.select(key).where(F.col(key).isNotNull()).distinct(), present.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unlisted")))


def claim_conflicts(claims: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Keys that are not in exactly one bucket: ``keys, buckets`` (sorted)."""
    return claims.groupBy(*keys).agg(F.array_sort(F.collect_set(bucket)).alias("buckets")).where(F.size("buckets") != 1)


def by_bucket(claims: DataFrame, domain: str, bucket: str, member: str, buckets: list[str]) -> DataFrame:
    """The members of every domain by bucket: one row a domain, one sorted list a bucket."""
    lists = [F.array_sort(F.collect_set(F.when(F.col(bucket) == b, F.col(member)))).alias(b) for b in buckets]
    return claims.groupBy(domain).agg(*lists)


def open_gaps(cells: DataFrame, group: str, value: str) -> DataFrame:
    """``group, cells, open``: how many cells of a group have no value; the gate passes where ``open`` is 0."""
    return cells.groupBy(group).agg(F.count("*").alias("cells"), F.count_if(F.col(value).isNull()).alias("open"))


def receipts_differ(a: DataFrame, b: DataFrame, key: str, identity: tuple[str, ...] = ()) -> DataFrame:
    """Where two receipts differ in anything but their identity columns: ``key, column``; null-safe."""
    cols = [c for c in a.columns if c != key and c not in identity]
    left = a.select(key, *[F.col(c).cast("string").alias(c) for c in cols], F.lit(True).alias("__a"))
    right = b.select(key, *[F.col(c).cast("string").alias(f"__{c}") for c in cols], F.lit(True).alias("__b"))
    both = left.join(right, key, "full")
    gone = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit("*"))
    odd = F.array_compact(F.array(gone, *[F.when(gone.isNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in cols]))
    return both.select(key, F.explode(odd).alias("column"))


def stable_evidence(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Whether all runs agree: one row a column with ``values`` (distinct, nulls counted) and ``stable``."""
    packed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.to_json(F.struct(F.col(c).cast("string").alias("v"))).alias("value")) for c in columns]))
    return runs.select(packed.alias("p")).groupBy("p.column").agg(F.countDistinct("p.value").alias("values")).withColumn("stable", F.col("values") <= 1)
