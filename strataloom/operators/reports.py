"""Totals, attribution of rows to files, level filters, revision diffs and incremental maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The row families of each detail level; each level holds those of the levels before it.
LEVELS = {
    "symbols": ("symbols", "parse_diagnostics"),
    "facts": ("symbol_annotations", "literals", "source_regions", "structural_facts", "complexity_metrics", "type_facts"),
    "references": ("relationships", "pending_relationships", "reference_sites"),
    "full": ("identifiers", "type_argument_usages", "type_arguments"),
}


def level_families(level: str) -> list[str]:
    out: list[str] = []
    for name, families in LEVELS.items():
        out += families
        if name == level:
            return out
    raise ValueError(f"no level {level}")


def strip_to_level(tables: dict[str, DataFrame], level: str) -> dict[str, DataFrame]:
    """The tables of a level; those of higher levels are emptied (their schema stays)."""
    keep = set(level_families(level)) | {"files"}
    return {n: t if n in keep else t.limit(0) for n, t in tables.items()}


def table_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rows`` of every table."""
    counts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")).select("table_name", "rows") for n, t in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts)


def attribution(files: DataFrame, domains: dict[str, DataFrame]) -> DataFrame:
    """Rows by file: file columns, one count column a domain, and ``total_rows``. Rows of unknown files are dropped.

    One grouped count over all domains together (a tagged union), not a join for each.
    """
    tagged = reduce(DataFrame.unionByName, [t.select("file_id", F.lit(n).alias("domain")) for n, t in domains.items()])
    names = sorted(domains)
    counts = tagged.groupBy("file_id").agg(*[F.count_if(F.col("domain") == n).alias(n) for n in names], F.count("*").alias("total_rows"))
    return files.join(counts, "file_id", "left").na.fill(0, [*names, "total_rows"])


def top_files(attributed: DataFrame, n: int = 20) -> DataFrame:
    """The report's largest files: by total rows, then path."""
    return attributed.orderBy(F.desc("total_rows"), "path").limit(n)


def revision_diff(old: DataFrame, new: DataFrame, supported: Column) -> DataFrame:
    """Changes between two file lists by content hash: ``file_id, change_kind`` of all but unchanged files."""
    a = old.select("file_id", F.col("content_hash").alias("old_hash"), F.lit(True).alias("o"))
    b = new.select("file_id", F.col("content_hash").alias("new_hash"), supported.alias("supported"), F.lit(True).alias("n"))
    kind = (
        F.when(F.col("n").isNull(), "deleted")
        .when(~F.col("supported"), "unsupported")
        .when(F.col("o").isNull(), "inserted")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated")
    )
    return a.join(b, "file_id", "full").select("file_id", kind.alias("change_kind")).where("change_kind is not null")


def apply_update(rows: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Replaces all rows of the touched files by the fresh ones."""
    return rows.join(touched.select("file_id").distinct(), "file_id", "left_anti").select(*rows.columns).unionByName(fresh)


def preserve_failed(current: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """Data-loss guard: files whose extraction failed keep their old rows; all others take the fresh ones."""
    ids = failed.select("file_id").distinct()
    kept = current.join(ids, "file_id", "left_semi").select(*current.columns)
    return fresh.join(ids, "file_id", "left_anti").select(*current.columns).unionByName(kept)


def hull() -> list[Column]:
    """The span hull of rows: minimum start, maximum end (line and column together)."""
    return [
        F.min(F.struct("start_line", "start_column")).alias("hull_start"), F.max(F.struct("end_line", "end_column")).alias("hull_end"),
        F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"),
    ]


def summary(col: str) -> list[Column]:
    """min, exact median and max of a measure, as in performance reports."""
    return [F.min(col).alias("lowest"), F.expr(f"percentile({col}, 0.5)").alias("middle"), F.max(col).alias("highest")]
