"""First-wins distinct, foreign-key policies and conflict reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by ``order`` (nulls first). A minimum over structs, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *[F.col(f"`{c}`") for c in rest])).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__b")[c].alias(c) for c in rest])


def conflicts(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """Keys claimed with differing payloads: ``keys, claims, diverging`` (sorted names of the columns that disagree).

    Compared with the first write's values, null-safe.
    """
    first = first_wins(df.select(*keys, *payload, *[o.alias(f"__k{i}") for i, o in enumerate(order)]), keys, [F.col(f"__k{i}") for i in range(len(order))])
    first = first.select(*keys, *[F.col(c).alias(f"first_{c}") for c in payload])
    both = df.join(first, keys)
    return (
        both.groupBy(*keys)
        .agg(F.count("*").alias("claims"), *[F.max(~F.col(c).eqNullSafe(F.col(f"first_{c}"))).alias(f"d_{c}") for c in payload])
        .withColumn("diverging", F.array_compact(F.array(*[F.when(F.col(f"d_{c}"), c) for c in sorted(payload)])))
        .where(F.size("diverging") > 0)
        .select(*keys, "claims", "diverging")
    )


def drop_dangling(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Required key: rows whose parent is missing (or null) go."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_semi").select(*child.columns)


def null_dangling(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Nullable key: rows stay, a dangling key becomes null."""
    known = parent.select(F.col(pk).alias("__pk")).distinct()
    return child.join(known, child[fk] == F.col("__pk"), "left").withColumn(fk, F.when(F.col("__pk").isNotNull(), F.col(fk))).select(*child.columns)


def dangling_count(child: DataFrame, fk: str, parent: DataFrame, pk: str, name: str) -> DataFrame:
    """One row ``fk_name, rows, dangling`` of a foreign key's check."""
    known = parent.select(F.col(pk).alias("__pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(known, F.col(fk) == F.col("__pk"), "left").agg(
        F.lit(name).alias("fk_name"), F.count("*").alias("rows"), F.count_if(F.col("__pk").isNull()).alias("dangling")
    ).select("fk_name", "rows", "dangling")


def difference(old: DataFrame, new: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Multiset difference both ways without volatile columns: the columns and ``side`` (removed or added)."""
    cols = [c for c in old.columns if c not in volatile]
    a, b = old.select(*cols), new.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def sync_snapshot(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Change-only mirroring: each key's ``action`` (delete, insert, update, keep) and its values afterwards."""
    values = [c for c in wanted.columns if c not in keys]
    cur = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("__cur"))
    new = wanted.select(*keys, *values, F.lit(True).alias("__new"))
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    action = (
        F.when(F.col("__new").isNull(), "delete").when(F.col("__cur").isNull(), "insert").when(same, "keep").otherwise("update")
    )
    return cur.join(new, keys, "full").select(*keys, *values, action.alias("action"))


def rekey(tables: dict[str, DataFrame], table: str, key: str, new_id: Column, references: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """New ids for a table's rows, and every reference to them rewritten through the map of old to new ids.

    ``references`` are (table, column), the table itself among them where it refers to itself. A reference to an
    unknown id stays as it is.
    """
    ids = tables[table].select(F.col(key).alias("__old"), new_id.alias("__new")).groupBy("__old").agg(F.min("__new").alias("__new"))
    out = dict(tables)
    for t, c in [(table, key), *references]:
        cols = out[t].columns
        out[t] = out[t].join(ids, out[t][c] == ids["__old"], "left").withColumn(c, F.coalesce("__new", F.col(c))).select(*cols)
    return out


def merge_first(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Existing rows, with incoming ones of new keys; and the incoming ones that disagree with an existing row."""
    known = existing.select(key)
    merged = existing.unionByName(incoming.join(known, key, "left_anti").select(*existing.columns))
    values = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*values).alias("__e"))
    odd = incoming.join(old, key).where(~F.struct(*values).eqNullSafe(F.col("__e"))).select(*existing.columns)
    return merged, odd
