"""Lexical scopes: chains of enclosing symbols, distances, and resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.hierarchy import resolve

TYPE_KINDS = ("class", "interface", "struct", "enum", "trait", "union", "type")


def scope_chains(symbols: DataFrame) -> DataFrame:
    """Each symbol's scope chain: ``symbol_id, scope_id, distance`` (itself at 0); symbols in or below a cycle have none."""
    tree = resolve(symbols, "symbol_id", "parent_symbol_id", "file_id")
    up = tree.where("path is not null").select(F.col("node_id").alias("symbol_id"), "depth", F.posexplode("path").alias("at", "scope_id"))
    return up.select("symbol_id", "scope_id", (F.col("depth") - F.col("at")).cast("long").alias("distance"))


def enclosing_types(symbols: DataFrame) -> DataFrame:
    """The nearest type around each symbol (not itself): ``symbol_id, type_id, distance``, null without one."""
    one = symbols.groupBy("symbol_id").agg(F.min("kind").alias("kind"), F.min("parent_symbol_id").alias("parent_symbol_id"), F.min("file_id").alias("file_id"))
    types = one.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("symbol_id").alias("scope_id"))
    near = (
        scope_chains(one).where("distance > 0").join(types, "scope_id")
        .groupBy("symbol_id").agg(F.min(F.struct("distance", "scope_id")).alias("n"))
    )
    return one.select("symbol_id").join(near, "symbol_id", "left").select("symbol_id", F.col("n.scope_id").alias("type_id"), F.col("n.distance").alias("distance"))


def resolve_nearest(references: DataFrame, symbols: DataFrame, target_kinds: tuple[str, ...]) -> DataFrame:
    """Name resolution by the nearest lexical scope: ``reference_id, outcome, target_id``.

    ``references`` has reference_id, file_id, caller_id and name. A binding is a symbol of the file with that name
    whose parent is a scope of the caller (or the file itself, farthest of all). At the least distance: none is
    missing; more than one, or one of another kind, is ambiguous; else resolved.
    """
    chain = scope_chains(symbols).select(F.col("symbol_id").alias("caller_id"), "scope_id", "distance")
    calls = references.select("reference_id", "file_id", "caller_id", "name")
    scopes = calls.join(chain, "caller_id", "left").select("reference_id", "file_id", "name", "scope_id", "distance")
    top = calls.select("reference_id", "file_id", "name", F.lit("").alias("scope_id"), F.lit(1 << 40).alias("distance"))
    visible = scopes.unionByName(top)
    bind = symbols.groupBy("symbol_id").agg(
        F.min("file_id").alias("file_id"), F.min("name").alias("name"), F.min("kind").alias("kind"), F.min(F.coalesce("parent_symbol_id", F.lit(""))).alias("scope_id")
    )
    hits = visible.where("scope_id is not null").join(bind, ["file_id", "name", "scope_id"])
    near = (
        hits.groupBy("reference_id", "distance")
        .agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(*target_kinds)).alias("good"), F.min("symbol_id").alias("target"))
        .groupBy("reference_id")
        .agg(F.min(F.struct("distance", "n", "good", "target")).alias("b"))
    )
    one = (F.col("b.n") == 1) & (F.col("b.good") == 1)
    return references.select("reference_id").join(near, "reference_id", "left").select(
        "reference_id",
        F.when(F.col("b").isNull(), "missing").when(one, "resolved").otherwise("ambiguous").alias("outcome"),
        F.when(one, F.col("b.target")).alias("target_id"),
    )


def unique_names(symbols: DataFrame, *by: str) -> DataFrame:
    """Names that exactly one symbol bears within ``by``: the columns, ``name`` and ``symbol_id``."""
    return (
        symbols.select(*by, "name", "symbol_id").distinct().groupBy(*by, "name")
        .agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")
    )


#: What a constructor call or a macro call may name, and what a call on the own object may.
CONSTRUCTABLE = ("class", "struct", "enum", "union", "type", "constructor")
CALLABLE = ("function", "method", "constructor", "import")


def resolve_constructable(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``resolve_nearest`` for what can be constructed."""
    return resolve_nearest(references, symbols, CONSTRUCTABLE)


def resolve_self_receiver(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """A call on the own object: the callable of that name in the type around the caller.

    ``reference_id, outcome, target_id``: resolved where exactly one is there, ambiguous where several are, else missing.
    """
    owner = enclosing_types(symbols).select(F.col("symbol_id").alias("caller_id"), "type_id")
    one = symbols.groupBy("symbol_id").agg(F.min("name").alias("name"), F.min("kind").alias("kind"), F.min("parent_symbol_id").alias("type_id"))
    inside = one.where(F.col("kind").isin(*CALLABLE) & F.col("type_id").isNotNull()).groupBy("type_id", "name").agg(F.count("*").alias("n"), F.min("symbol_id").alias("target"))
    hit = references.select("reference_id", "caller_id", "name").join(owner, "caller_id", "left").join(inside, ["type_id", "name"], "left")
    return hit.select(
        "reference_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("outcome"),
        F.when(F.col("n") == 1, F.col("target")).alias("target_id"),
    )


def resolve_preceding(references: DataFrame, symbols: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A macro call: of the declarations of that name before the call, in a scope of the caller, the nearest; of several
    there the latest. ``references`` also has at_byte. ``reference_id, target_id`` (null without one)."""
    chain = scope_chains(symbols).select(F.col("symbol_id").alias("caller_id"), "scope_id", "distance")
    calls = references.select("reference_id", "file_id", "caller_id", "name", "at_byte")
    seen = calls.join(chain, "caller_id").drop("caller_id")
    top = calls.drop("caller_id").select("*", F.lit("").alias("scope_id"), F.lit(1 << 40).alias("distance"))
    one = symbols.where(F.col("kind").isin(*kinds)).groupBy("symbol_id").agg(
        F.min("file_id").alias("file_id"), F.min("name").alias("name"), F.min("start_byte").alias("start_byte"), F.min(F.coalesce("parent_symbol_id", F.lit(""))).alias("scope_id")
    )
    hits = seen.unionByName(top.select(*seen.columns)).join(one, ["file_id", "name", "scope_id"]).where("start_byte <= at_byte")
    best = hits.groupBy("reference_id").agg(F.min(F.struct("distance", (-F.col("start_byte")).alias("back"), "symbol_id")).alias("b"))
    return references.select("reference_id").join(best, "reference_id", "left").select("reference_id", F.col("b.symbol_id").alias("target_id"))


def retain(symbols: DataFrame, keep: Column) -> DataFrame:
    """The kept symbols, each below its nearest kept ancestor: ``symbol_id, parent_symbol_id`` (null without one).

    Symbols in or below a cycle of parents keep no parent.
    """
    one = symbols.select("symbol_id", "parent_symbol_id", "file_id", keep.alias("kept")).groupBy("symbol_id").agg(
        F.min("parent_symbol_id").alias("parent_symbol_id"), F.min("file_id").alias("file_id"), F.max("kept").alias("kept")
    )
    kept = one.where("kept").select("symbol_id")
    up = scope_chains(one).where("distance > 0").join(kept.withColumnRenamed("symbol_id", "scope_id"), "scope_id")
    near = up.groupBy("symbol_id").agg(F.min(F.struct("distance", "scope_id")).alias("n"))
    return kept.join(near, "symbol_id", "left").select("symbol_id", F.col("n.scope_id").alias("parent_symbol_id"))
