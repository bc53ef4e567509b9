"""Schemas that drift between files: rescue-column ingestion and a report of every change.

Each payload is parsed once. Fields of the target schema whose values have the column's own JSON type become typed
columns; everything else (unknown fields, other types, nulls) stays as JSON in ``_rescued``, so columns and rescue
together hold the payload. Approved fields are promoted: their rescued values are replayed into typed columns. What a
batch's fields are is read back from the typed columns and the rescue, and changes are reported from that.

The parse itself is Python in Arrow batches: a variant does not tell 1.0 from 1, which are different types here.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import cut

#: The target types: Spark's type, and the JSON type whose values a column takes as they are.
TYPES = {"string": (T.StringType(), "string"), "long": (T.LongType(), "integer"), "double": (T.DoubleType(), "decimal"), "boolean": (T.BooleanType(), "boolean")}
#: The JSON types as bits, so that a field's types in a batch are one number.
KIND_BITS = {"string": 1, "integer": 2, "decimal": 4, "boolean": 8, "array": 16}
def flatten(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """The leaf fields of an object, nested keys joined with a dot. Objects themselves are no fields."""
    stack = [(prefix, obj)]
    while stack:
        at, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{at}{k}.", v))
            else:
                yield at + k, v


def fits(v: object, target: str) -> bool:
    """Whether a value is one of the target column's own JSON type, within its range."""
    if target == "string":
        return isinstance(v, str) and whole(v)
    if target == "boolean":
        return isinstance(v, bool)
    if target == "long":
        return isinstance(v, int) and not isinstance(v, bool) and -(2**63) <= v < 2**63
    return isinstance(v, float) and math.isfinite(v)


def lenient(v: object, target: str) -> object:
    """A rescued value cast to the target type where that keeps its meaning, else None."""
    if v is None or fits(v, target):
        return v
    if target == "string":
        return None if isinstance(v, str) else dump(v)
    text = str(v).strip().lower()
    if target == "boolean":
        return {"true": True, "false": False}.get(text)
    if isinstance(v, (bool, list)):
        return None
    try:
        n = float(text) if target == "double" else int(v) if isinstance(v, float) and v.is_integer() else int(text)
    except (ValueError, OverflowError):
        return None
    return n if fits(n, target) else None


def dump(v: object) -> str:
    """JSON text with sorted keys; half a surrogate pair, which no text column holds, stays escaped."""
    out = json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return out if whole(out) else json.dumps(v, sort_keys=True, separators=(",", ":"))


def whole(text: str) -> bool:
    """Whether a text has no half surrogate pair."""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def parsed(text: str) -> object:
    """A payload's JSON value, or None where it is none (NaN and Infinity are no JSON)."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return None


def _names(keep: list[str], target: dict[str, str]) -> dict[str, str]:
    names: dict[str, str] = {}
    for f in target:
        c = f.replace(".", "_")
        while c in keep or c in names.values() or c == "_rescued":
            c += "_"
        names[f] = c
    return names


def ingest(raw: DataFrame, payload: str, target: dict[str, str], keep: list[str]) -> DataFrame:
    """Reads JSON payloads into ``keep`` columns, the typed ``target`` columns and ``_rescued``.

    ``target`` maps a (dotted) field to string, long, double or boolean. ``_rescued`` holds, as a JSON object with
    sorted keys, every field that the target does not know, whose value is of another JSON type than the column (an
    integer for a double column too) or null; it is null where nothing is left. A payload that is null, no JSON or no
    object gives null columns and, unless null, ``{"_corrupt": text}``. Target columns take underscores for dots;
    where a name clashes with a kept column the kept one wins its name and the target gets a trailing underscore.
    """
    names = _names(keep, target)
    schema = T.StructType([raw.schema[k] for k in keep])
    for f, t in target.items():
        schema = schema.add(names[f], TYPES[t][0])
    schema = schema.add("_rescued", T.StringType())

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        for b in batches:
            cols: dict[str, list] = {f: [] for f in target}
            rescued = []
            for text in b.column(b.schema.get_field_index("__payload")).to_pylist():
                seen, left = {}, {}
                if text is not None:
                    obj = parsed(text)
                    if isinstance(obj, dict):
                        for f, v in flatten(obj):
                            t = target.get(f)
                            if t is not None and fits(v, t):
                                seen[f] = v
                            else:
                                left[f] = v
                    else:
                        left["_corrupt"] = text
                for f, col in cols.items():
                    col.append(seen.get(f))
                rescued.append(dump(left) if left else None)
            data = [b.column(b.schema.get_field_index(k)) for k in keep]
            data += [pa.array(col, out_schema.field(names[f]).type) for f, col in cols.items()]
            data.append(pa.array(rescued, pa.string()))
            yield pa.RecordBatch.from_arrays([d.cast(out_schema.field(i).type) for i, d in enumerate(data)], schema=out_schema)

    return raw.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{payload}`").cast("string").alias("__payload")).mapInArrow(parse, schema)


def replay(ingested: DataFrame, approved: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """Promotes approved fields: ``approved`` maps a column to its type and the fields whose rescued values it takes.

    An existing column of that name keeps its values; where it is null, the first of the fields with a rescued value
    that casts without loss of meaning fills it. What was replayed, and nulls of approved fields, leave ``_rescued``;
    values that do not cast stay there. All fields are promoted in one pass.
    """
    at = ingested.columns.index("_rescued")
    schema = T.StructType(list(ingested.schema))
    for c, (kind, _) in approved.items():
        if c not in ingested.columns:
            schema = schema.add(c, TYPES[kind][0])
    cols = [f.name for f in schema]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for b in batches:
            n = b.num_rows
            values = {c: b.column(cols.index(c)).to_pylist() if cols.index(c) < b.num_columns else [None] * n for c in approved}
            rescued = b.column(at).to_pylist()
            for i, text in enumerate(rescued):
                if text is None:
                    continue
                left = json.loads(text)
                for c, (kind, fields) in approved.items():
                    for f in fields:
                        if f not in left:
                            continue
                        v = lenient(left[f], kind)
                        if left[f] is None:
                            del left[f]
                        elif values[c][i] is None and v is not None:
                            values[c][i] = v
                            del left[f]
                rescued[i] = dump(left) if left else None
            data = []
            for k, name in enumerate(cols):
                kind = out.field(k).type
                data.append(pa.array(rescued, kind) if k == at else pa.array(values[name], kind) if name in values else b.column(k).cast(kind))
            yield pa.RecordBatch.from_arrays(data, schema=out)

    return ingested.mapInArrow(run, schema)


def promote(ingested: DataFrame, field: str, kind: str, column: str | None = None, aliases: tuple[str, ...] = ()) -> DataFrame:
    """Promotes one approved field, under its name or an alias; see ``replay``."""
    return replay(ingested, {column or field.replace(".", "_"): (kind, (field, *aliases))})


def fields(ingested: DataFrame, target: dict[str, str], keep: list[str]) -> DataFrame:
    """The fields of every record, read back from its typed columns and its rescue: ``keep..., field, kind, value``.

    ``kind`` is the bit of the JSON type (0 for null, which has none), ``value`` the text of a string or the JSON text
    of any other value. A record without any field gives one row with a null field.
    """
    names = _names(keep, target)
    typed = [
        F.struct(F.lit(f).alias("field"), F.when(F.col(f"`{names[f]}`").isNotNull(), KIND_BITS[TYPES[t][1]]).alias("kind"), F.col(f"`{names[f]}`").cast("string").alias("value"))
        for f, t in target.items()
    ]
    texts, kinds = F.from_json("_rescued", "map<string,string>"), F.from_json("_rescued", "map<string,variant>")

    def one(k):
        text, kind = F.element_at("__texts", k), F.schema_of_variant(F.element_at("__kinds", k))
        bit = (
            F.when(text.isNull(), 0).when(kind == "STRING", KIND_BITS["string"]).when(kind == "BOOLEAN", KIND_BITS["boolean"])
            .when(kind.startswith("ARRAY"), KIND_BITS["array"]).when(text.rlike("[.eEIN]"), KIND_BITS["decimal"]).otherwise(KIND_BITS["integer"])
        )
        return F.struct(k.alias("field"), bit.alias("kind"), text.alias("value"))

    lost = F.col("_rescued").startswith('{"_corrupt":')
    rescued = F.when(F.col("__texts").isNull() | lost, F.array().cast("array<struct<field:string,kind:int,value:string>>")).otherwise(F.transform(F.map_keys("__texts"), one))
    all_ = F.concat(F.filter(F.array(*typed), lambda x: x.kind.isNotNull()), rescued) if typed else rescued
    out = ingested.withColumn("__texts", texts).withColumn("__kinds", kinds).select(*[F.col(f"`{k}`") for k in keep], F.explode_outer(all_).alias("f"))
    return out.select(*[F.col(f"`{k}`") for k in keep], "f.field", "f.kind", "f.value")


#: Changed fields that are sent to every task; beyond them they meet the values by a shuffled join.
SENT = 500_000


def changes(ingested: DataFrame, target: dict[str, str], feed: str, batch: str, record: str, sent: int = SENT) -> DataFrame:
    """Every change of a feed's fields from one batch to the next.

    ``ingested`` as of ``ingest`` with ``target``; ``record`` is the target field that names the same record across
    batches. Result: ``feed, batch_no, change_type, old_field, new_field``. A field is in a batch when a record has
    its key; its type is the type of its non-null values, and it is retyped where both batches have non-null values
    of other types. Renamed: gone and new, with at least one record that has both non-null values, and all of these
    equal. Batches whose predecessor is missing report nothing; rows with null feed or batch are left out; repeated
    rows change nothing. Everything is keyed by feed, batch and field or record, so a hot feed spreads over its
    batches. Field lists are combined before the shuffle, and of the values only those of changed fields move.
    """
    # the target columns are those before the rescue
    at = ingested.columns.index("_rescued")
    theirs = dict(zip(target, ingested.columns[at - len(target) : at]))
    mine = _names(["feed", "batch_no", "__record"], target)
    got = ingested.select(
        F.col(f"`{feed}`").alias("feed"), F.col(f"`{batch}`").cast("long").alias("batch_no"), F.col(f"`{theirs[record]}`").alias("__record"),
        *[F.col(f"`{theirs[f]}`").alias(mine[f]) for f in target], "_rescued",
    ).where("feed is not null and batch_no is not null")
    base = fields(got, target, ["feed", "batch_no", "__record"])
    present = base.groupBy("feed", "batch_no", "field").agg(F.bit_or(F.coalesce("kind", F.lit(0))).alias("kinds"))
    now = present.select("feed", "batch_no", F.col("field").alias("k"), F.col("kinds").alias("new"), F.lit(None).cast("int").alias("old"))
    before = present.select("feed", (F.col("batch_no") + 1).alias("batch_no"), F.col("field").alias("k"), F.lit(None).cast("int"), F.col("kinds"))
    # both batches of a field side by side; a null field only says that the batch is there
    both = W.partitionBy("feed", "batch_no")
    side = now.union(before).repartition("feed", "batch_no").groupBy("feed", "batch_no", "k").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    side = side.withColumn("pair", F.max(F.col("new").isNotNull()).over(both) & F.max(F.col("old").isNotNull()).over(both))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when((F.col("old") != 0) & (F.col("new") != 0) & (F.col("old") != F.col("new")), "retyped")
    )
    diff = cut(side.where("pair and k is not null").select("feed", "batch_no", "k", kind.alias("change_type")).where("change_type is not null"))
    # values of gone fields beside values of new ones, record by record, where a batch has both
    moved = diff.where("change_type <> 'retyped'").withColumn("sides", F.size(F.collect_set("change_type").over(both))).where("sides = 2")
    gone = F.col("change_type") == "removed"
    moved = cut(moved.select("feed", (F.col("batch_no") - F.when(gone, 1).otherwise(0)).alias("batch_no"), F.col("k").alias("field"), gone.alias("gone")))
    look = F.broadcast(moved) if moved.count() <= sent else moved.hint("merge")
    valued = base.where("value is not null and __record is not null").join(look, ["feed", "batch_no", "field"])
    valued = valued.groupBy("feed", (F.col("batch_no") + F.when(F.col("gone"), 1).otherwise(0)).alias("batch_no"), "__record").agg(
        F.collect_set(F.when(F.col("gone"), F.struct("field", "kind", "value"))).alias("olds"), F.collect_set(F.when(~F.col("gone"), F.struct("field", "kind", "value"))).alias("news")
    )
    renamed = cut(
        valued.select("feed", "batch_no", F.explode("olds").alias("o"), "news").select("feed", "batch_no", "o", F.explode("news").alias("n"))
        .groupBy("feed", "batch_no", F.col("o.field").alias("old_field"), F.col("n.field").alias("new_field"))
        .agg(F.bool_and((F.col("o.kind") == F.col("n.kind")) & (F.col("o.value") == F.col("n.value"))).alias("same"))
        .where("same")
        .select("feed", "batch_no", F.lit("renamed").alias("change_type"), "old_field", "new_field")
    )
    used = renamed.select(
        "feed", "batch_no",
        F.explode(F.array(F.struct(F.lit("removed").alias("change_type"), F.col("old_field").alias("k")), F.struct(F.lit("added").alias("change_type"), F.col("new_field").alias("k")))).alias("u"),
    ).select("feed", "batch_no", "u.change_type", "u.k")
    # checkpoints have no size estimate worth trusting, so no side is broadcast here
    rest = diff.join(used.hint("merge"), ["feed", "batch_no", "change_type", "k"], "left_anti").select(
        "feed", "batch_no", "change_type",
        F.when(F.col("change_type") == "added", F.lit("")).otherwise(F.col("k")).alias("old_field"),
        F.when(F.col("change_type") == "removed", F.lit("")).otherwise(F.col("k")).alias("new_field"),
    )
    return rest.unionByName(renamed)


def lineage(report: DataFrame, approved: list[str], most: int = 10_000) -> dict[str, tuple[str, ...]]:
    """The names each approved field has had, nearest first, by the renames of a change report.

    Only distinct pairs of names reach the driver; they grow with the schemas, not with the data, and more than
    ``most`` are refused. A pair counts where at least two batches report it, so a chance equality of values in one
    does not join two fields. A name goes to the approved field with the fewest renames between them; an equal
    distance to two gives it to neither.
    """
    pairs = report.where("change_type = 'renamed'").groupBy(
        F.least("old_field", "new_field").alias("old_field"), F.greatest("old_field", "new_field").alias("new_field")
    ).agg(F.countDistinct("feed", "batch_no").alias("n")).where("n > 1")
    rows = pairs.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct renames")
    near: dict[str, set[str]] = {}
    for r in rows:
        near.setdefault(r.old_field, set()).add(r.new_field)
        near.setdefault(r.new_field, set()).add(r.old_field)
    owner: dict[str, str | None] = {f: f for f in approved}
    out: dict[str, list[str]] = {f: [] for f in approved}
    ring = {f: {f} for f in approved}
    while any(ring.values()):
        claims: dict[str, set[str]] = {}
        for f, names in ring.items():
            for n in names:
                for m in near.get(n, ()):
                    if m not in owner:
                        claims.setdefault(m, set()).add(f)
        ring = {f: set() for f in approved}
        for m in sorted(claims):
            owner[m] = next(iter(claims[m])) if len(claims[m]) == 1 else None
            if owner[m] is not None:
                out[owner[m]].append(m)
                ring[owner[m]].add(m)
    return {f: tuple(n) for f, n in out.items()}
