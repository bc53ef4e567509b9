"""Text, path, name and URL expressions, all inside Spark's code generation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """0 for empty text; a trailing newline starts no line."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def normalize_path(path: Column) -> Column:
    """Slashes forward, no ``./`` before and no doubled ones."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), r"^(\./)+", "")


def relative_to(path: Column, root: str) -> Column:
    """The path below a root; null for paths outside it."""
    r = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(r)), F.substring(path, len(r) + 1, 1 << 20))


def repository(path: Column) -> Column:
    return F.split_part(normalize_path(path), F.lit("/"), F.lit(1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normalize_path(path), "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension, empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def strip_type_decorations(t: Column) -> Column:
    """A type's bare name: no references, generic arguments or nullable marks."""
    bare = F.regexp_replace(F.trim(t), r"^(&\s*(mut\s+)?|\*+\s*(const\s+|mut\s+)?|ref\s+)+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<.*$|\[.*$", ""), r"[?!*&]+$", ""))


def bindable_type_name(t: Column) -> Column:
    """Whether a type's text is one name: no white space or comma, angle brackets in order."""
    return ~t.rlike(r"[\s,]") & ~t.rlike(r"<$") & ~(t.contains(">") & ~t.contains("<")) & (t != "")


def chain_parts(chain: Column) -> Column:
    """``a.b::c->d`` in its parts; empty ones are dropped."""
    return F.filter(F.split(chain, r"\.|::|->|\\"), lambda x: x != "")


def chain_target(chain: Column) -> Column:
    """display, terminal, receiver and namespace of a dotted chain."""
    p = chain_parts(chain)
    n = F.size(p)
    return F.struct(
        chain.alias("display"),
        F.when(n > 0, F.element_at(p, -1)).alias("terminal"),
        F.when(n > 1, F.try_element_at(p, F.lit(-2))).alias("receiver"),
        F.when(n > 2, F.slice(p, F.lit(1), n - 2)).otherwise(F.array().cast("array<string>")).alias("namespace"),
    )


def plain_identifier(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_$@][\p{L}\p{N}_$@]*$")


def member_path(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*(\.[\p{L}_$][\p{L}\p{N}_$]*)+$")


def normalize_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(label), r"\s+", " "))


def slug(title: Column) -> Column:
    """The anchor of a heading: lower case, punctuation dropped, spaces to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}\s_-]", ""), r"\s", "-")


def sql_identifier(name: Column) -> Column:
    """Without quotes, back ticks or brackets, part by part."""
    return F.regexp_replace(name, r"[\"`\[\]]", "")


def sql_string(text: Column) -> Column:
    """The content of an SQL string with its prefix."""
    return F.replace(F.regexp_extract(text, r"^(?i:N|E|B|X|U&)?'((?s:.*))'$", 1), F.lit("''"), F.lit("'"))


def string_literal(text: Column) -> Column:
    """A literal without its delimiters; interpolated holes become ``{}``."""
    bare = F.regexp_replace(text, r"^[A-Za-z$@]*(\"\"\"|'''|[\"'`])|(\"\"\"|'''|[\"'`])$", "")
    return F.regexp_replace(bare, r"\$\{[^}]*\}|#\{[^}]*\}|\{[^{}]*\}", "{}")


def annotation(raw: Column) -> Column:
    """(annotation, key, raw, carrier) of a decorator or attribute text."""
    name = F.regexp_extract(F.trim(raw), r"^(?:@|#!?\[|\[+)?\s*([\w.:]+)", 1)
    return F.struct(
        name.alias("annotation"), F.lower(F.element_at(F.split(name, r"\.|::"), -1)).alias("annotation_key"), raw.alias("raw_text"),
        F.when(F.size(F.split(name, r"\.|::")) > 1, F.element_at(F.split(name, r"\.|::"), 1)).alias("carrier"),
    )


# How each flavour of route writes a parameter (pattern, what it becomes).
ROUTE_FLAVOURS = {
    "colon": (r":([A-Za-z_]\w*)(?:\([^)]*\))?[?*+]?", r":$1"),
    "braces": (r"\{\**([A-Za-z_]\w*)(?::[^{}]*|=[^{}]*)?\??\}", r":$1"),
    "angle": (r"<(?:[A-Za-z_]\w*(?:\([^)]*\))?:)?([A-Za-z_]\w*)(?:\.\.)?>", r":$1"),
    "brackets": (r"\[+(?:\.\.\.)?([A-Za-z_]\w*)\]+", r":$1"),
    "regex": (r"\(\?P?<([A-Za-z_]\w*)>[^)]*\)", r":$1"),
}


def normalize_route(template: Column, flavour: Column) -> Column:
    """A route template rooted at ``/`` with ``:name`` parameters, whatever flavour it is written in."""
    t = template
    done = None
    for name, (pattern, to) in ROUTE_FLAVOURS.items():
        x = F.regexp_replace(F.regexp_replace(t, r"^\^|\$$", ""), pattern, to) if name == "regex" else F.regexp_replace(t, pattern, to)
        done = F.when(flavour == name, x) if done is None else done.when(flavour == name, x)
    x = F.regexp_replace(F.concat(F.lit("/"), done.otherwise(t)), "/{2,}", "/")
    return F.when(x == "/", x).otherwise(F.regexp_replace(x, "/$", ""))


def dynamic_segments(route: Column) -> Column:
    return F.regexp_extract_all(route, F.lit(r":([A-Za-z_]\w*)"), F.lit(1))


def url_kind(url: Column) -> Column:
    """absolute, path or relative."""
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://|^//"), "absolute").when(F.startswith(url, F.lit("/")), "path").otherwise("relative")


def import_source_kind(source: Column) -> Column:
    return F.when(source.rlike(r"^\.{1,2}(/|$)|^/"), "relative").otherwise("external")


def document_stem(uri: Column) -> Column:
    """The name of a document without folder, query, fragment and extension."""
    return F.regexp_replace(F.regexp_extract(uri, r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", "")


def normalize_uri(uri: Column) -> Column:
    return F.regexp_replace(F.trim(uri), r"/+$", "")


def tag_attributes(text: Column) -> Column:
    """The attributes of a tag's text as a map; of repeated names the last counts."""
    pattern = F.lit(r"([\w:@.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
    names = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.lower(x))
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.aggregate(
        F.arrays_zip(names.alias("k"), values.alias("v")), F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )


def semantic_line(line: Column) -> Column:
    """A comment line without one leading and one trailing decoration."""
    bare = F.regexp_replace(F.trim(line), r"^(///?|//!|/\*\*?|\*(?!/)|#+|--+|;+|<!--|%+|\"\"\"|''')\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*(\*/|-->|\"\"\"|''')\s*$", ""))


def marker(line: Column) -> Column:
    """(marker, owner, description) of a comment line that begins with a marker, else nulls."""
    # The marker words
    pattern = r"^(TODO|FIXME|HACK|XXX|RAZORBACK)(?:\(([^)]*)\))?(?:[:\s-]\s*(.*))?$"
    hit = line.rlike(pattern)
    part = lambda i: F.when(hit, F.nullif(F.regexp_extract(line, pattern, i), F.lit("")))
    return F.struct(part(1).alias("marker"), part(2).alias("owner"), part(3).alias("description"))


#: Words, quoted texts and single signs, once comments are gone.
#: Loops are possessive: the JVM's regular expressions go one call deeper for every turn of a loop over alternatives.
QUOTED = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
TOKEN = QUOTED + r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[\p{L}\p{N}_]++|[^\s\p{L}\p{N}_]"
COMMENTS = r"(?s)/\*.*?\*/|(?-s://.*|(?<=^|\s)#.*)"


def body_tokens(body: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(body, COMMENTS, " "), F.lit(TOKEN), F.lit(0))


def body_hash(body: Column) -> Column:
    """md5 of the body's tokens without comments: equal for exact clones in any layout."""
    return F.md5(F.array_join(body_tokens(body), "\x1f"))


def regex_complexity(pattern: Column) -> Column:
    """Quantifiers, classes, alternations and properties count one, groups with a question mark two."""
    n = lambda p: F.regexp_count(pattern, F.lit(p))
    return n(r"(?<!\()[*+?]|\{\d") + n(r"\[") + n(r"\|") + n(r"\\p\{") + 2 * n(r"\(\?")


def join_route(prefix: Column, template: Column) -> Column:
    """A router's prefix and a route's template with one slash between them."""
    slashed, rooted = F.endswith(prefix, F.lit("/")), F.startswith(template, F.lit("/"))
    return (
        F.when(template == "", prefix)
        .when(slashed & rooted, F.concat(F.regexp_replace(prefix, "/+$", ""), template))
        .when(~slashed & ~rooted, F.concat(prefix, F.lit("/"), template))
        .otherwise(F.concat(prefix, template))
    )


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b", "0": "\0"}
_ESCAPE = r"\\(u\{([0-9A-Fa-f_]{1,8})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|\r?\n|[\s\S])"


def unescape(text: str) -> str:
    """A string's content with its escapes decoded; an unknown escape is the character itself, surrogate pairs are one."""

    def one(m: re.Match) -> str:
        code = m[2] or m[3] or m[4] or m[5]
        if code:
            n = int(code.replace("_", ""), 16)
            return chr(n) if n < 0x110000 else m[0]
        return "" if m[1] in ("\n", "\r\n") else _ESCAPES.get(m[1], m[1])

    return re.sub(_ESCAPE, one, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def string_value(raw: Column) -> Column:
    """The text of a quoted string literal with its escapes decoded, in Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unescape(re.sub(r"^([\"'`])([\s\S]*)\1$", r"\2", v)))

    return decode(raw)


def toml_string(raw: str) -> str | None:
    """The text of a TOML string of any of its four kinds; None where it is none."""
    for q, plain in (('"""', False), ("'''", True), ('"', False), ("'", True)):
        if len(raw) >= 2 * len(q) and raw.startswith(q) and raw.endswith(q):
            inner = raw[len(q) : -len(q)]
            if len(q) == 3:
                inner = re.sub(r"\A\r?\n", "", inner)
            return inner if plain else unescape(re.sub(r"\\[ \t]*\r?\n\s*", "", inner))
    return None


def yaml_scalar(raw: str) -> str:
    """The text of a YAML scalar by its style, line breaks folded to blanks."""
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] == '"':
        text = unescape(raw[1:-1])
    elif len(raw) > 1 and raw[0] == raw[-1] == "'":
        text = raw[1:-1].replace("''", "'")
    else:
        text = raw
    return " ".join(line.strip() for line in text.split("\n")) if "\n" in text else text


def folded_pattern(pattern: str) -> str:
    """A regular expression on one line; in verbose mode (a first line of flags with x) without its comments."""
    lines = pattern.splitlines()
    first = next((line.strip() for line in lines if line.strip()), "")
    if re.fullmatch(r"\(\?[a-z]*x[a-z]*(?:-[a-z]+)?\)", first):
        lines = [re.sub(r"(?<!\\)#.*$", "", re.sub(r"\[(?:\\.|[^\]])*\]", lambda m: m[0].replace("#", "\0"), line)).replace("\0", "#") for line in lines]
    return "".join(line.strip() for line in lines)
