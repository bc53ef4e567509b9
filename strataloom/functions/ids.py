"""Identity: content hashes, stable ids and location ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates (and ends) the parts of a stable id.
SEPARATOR = "\x1f"


def content_hash(content: Column) -> Column:
    """``sha256:<hex>`` of bytes or text."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix-`` and 32 hex digits of the hash of all parts, each followed by the separator. A null part counts as empty."""
    ended = [F.concat(F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")), F.lit(SEPARATOR)) for p in parts]
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat(*ended), 256), 1, 32))


def location_id(path: Column, name: Column, *span: Column) -> Column:
    """md5 of ``path:name:start line:start column:end line:end column:start byte:end byte``."""
    return F.md5(F.concat_ws(":", path, name, *[s.cast("string") for s in span]))


def reference_site_id(file_id: Column, row_id: Column, start: Column, end: Column) -> Column:
    """Exact where the span is known, else by the row that asks for the site."""
    return F.when(start.isNotNull() & end.isNotNull(), stable_id("site", file_id, start, end)).otherwise(stable_id("site", file_id, row_id))


def relationship_id(previous: Column, from_id: Column, to_id: Column, kind: Column) -> Column:
    return F.concat_ws("_", from_id, to_id, kind, F.md5(previous))


def fingerprint(json_text: Column) -> Column:
    """``sha256:`` of canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(json_text, 256))


def canonical_map(m: Column) -> Column:
    """A map as JSON with sorted keys; null stays null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def metadata_flag(metadata_json: Column, key: str) -> Column:
    """A boolean key of metadata, false by default."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(metadata_json), f"$.{key}", "boolean"), F.lit(False))


def render_value(value: Column, kind: str) -> Column:
    """A value with its type before it, as in table dumps: int, real, text, blob or null."""
    name = {"bigint": "int", "int": "int", "double": "real", "float": "real", "boolean": "int", "binary": "blob"}.get(kind, "text")
    text = F.hex(value) if name == "blob" else value.cast("int").cast("string") if kind == "boolean" else value.cast("string")
    text = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.when(value.isNull(), "null:").otherwise(F.concat(F.lit(name + ":"), text))
