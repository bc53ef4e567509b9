"""Queries over the test tables, one or more for each relational operator of the engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import ids, text
from strataloom.operators import audit, generics, integrity, outline, reports, scope, spans
from strataloom.session import table, utc_micros
from strataloom.sources.languages import LANGUAGES, detect

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def _symbols(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Symbols without their repeated rows."""
    cols = cols or ("symbol_id", "file_id", "path", "language", "name", "kind", "signature", "doc_comment", "parent_symbol_id", "start_line", "start_column",
                    "end_line", "end_column", "start_byte", "end_byte", "body_start_byte", "body_end_byte", "body_hash", "is_test", "confidence")
    return table(s, d, "symbols").select(*cols).distinct()


# ---------------------------------------------------------------- snapshots, paths, ids

_LINES = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END END"


@query(f"""
SELECT DISTINCT file_id, path, 'sha256:' || sha256(content) AS content_hash, CAST(strlen(content) AS BIGINT) AS content_bytes,
  CAST({_LINES} AS BIGINT) AS line_count, strlen(content) > 1048576 AS too_large FROM file_snapshots""")
def files_snapshot(s, d):
    c = F.col("content")
    return table(s, d, "file_snapshots").select(
        "file_id", "path", ids.content_hash(c).alias("content_hash"), F.octet_length(c).cast("long").alias("content_bytes"),
        text.line_count(c).alias("line_count"), (F.octet_length(c) > (1 << 20)).alias("too_large"),
    ).distinct()


_EXT = " ".join(
    "WHEN lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN ({}) THEN '{}'".format(", ".join(f"'{e}'" for e in l.extensions), l.name)
    for l in LANGUAGES.values()
    if l.extensions
)
_NAMES = " ".join(f"WHEN name = '{f}' THEN '{l.name}'" for l in LANGUAGES.values() for f in l.files)
_CLEAN = r"regexp_replace(regexp_replace(replace(trim(path), '\', '/'), '/{2,}', '/', 'g'), '^(\./)+', '')"


@query(f"""
WITH p AS (SELECT DISTINCT {_CLEAN} AS path FROM revision_file_changes), n AS (SELECT path, list_last(string_split(path, '/')) AS name FROM p)
SELECT path, CASE {_NAMES} {_EXT} END AS language FROM n""")
def detect_language(s, d):
    p = table(s, d, "revision_file_changes").select(text.normalize_path(F.col("path")).alias("path")).distinct()
    return p.select("path", detect(F.col("path")).alias("language"))


@query(f"""
SELECT split_part({_CLEAN}, '/', 1) AS repository, list_last(string_split({_CLEAN}, '/')) AS file_name,
  lower(regexp_extract(list_last(string_split({_CLEAN}, '/')), '\\.([^.]+)$', 1)) AS extension, count(*) AS n
FROM revision_file_changes GROUP BY ALL""")
def path_parts(s, d):
    p = F.col("path")
    return table(s, d, "revision_file_changes").select(
        text.repository(p).alias("repository"), text.file_name(p).alias("file_name"), text.extension(p).alias("extension")
    ).groupBy("repository", "file_name", "extension").agg(F.count("*").alias("n"))


@query("""
SELECT DISTINCT symbol_id, md5(concat_ws(':', path, name, start_line, start_column, end_line, end_column, start_byte, end_byte)) AS location_id,
  'symbol-' || substr(sha256(path || chr(31) || name || chr(31) || start_byte || chr(31)), 1, 32) AS stable_id FROM symbols""")
def stable_ids(s, d):
    c = F.col
    sym = _symbols(s, d)
    return sym.select(
        "symbol_id",
        ids.location_id(c("path"), c("name"), c("start_line"), c("start_column"), c("end_line"), c("end_column"), c("start_byte"), c("end_byte")).alias("location_id"),
        ids.stable_id("symbol", c("path"), c("name"), c("start_byte")).alias("stable_id"),
    ).distinct()


@query("""
SELECT DISTINCT symbol_id, 'site-' || substr(sha256(CASE WHEN body_start_byte IS NOT NULL AND body_end_byte IS NOT NULL
  THEN file_id || chr(31) || body_start_byte || chr(31) || body_end_byte || chr(31) ELSE file_id || chr(31) || symbol_id || chr(31) END), 1, 32) AS site_id FROM symbols""")
def reference_site_ids(s, d):
    c = F.col
    return _symbols(s, d).select("symbol_id", ids.reference_site_id(c("file_id"), c("symbol_id"), c("body_start_byte"), c("body_end_byte")).alias("site_id")).distinct()


@query("""
SELECT DISTINCT file_id, coalesce(try_cast(json_extract(metadata_json, '$.generated') AS BOOLEAN), false) AS generated FROM files""")
def metadata_flags(s, d):
    return table(s, d, "files").select("file_id", ids.metadata_flag(F.col("metadata_json"), "generated").alias("generated")).distinct()


@query("""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
x AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i, len(l) AS n FROM p),
o AS (SELECT doc_id, i, t, n, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_delta, CAST(off AS BIGINT) AS byte_delta, sha256(t) AS record_hash FROM o WHERE trim(t, ' ' || chr(9) || chr(13)) <> '' AND NOT (i = n AND t = '')""")
def jsonl_records(s, d):
    """Non-blank records of line-oriented text with the offsets that spans are shifted by."""
    ls = spans.line_offsets(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return ls.where(F.trim(F.translate("line_text", "\t\r", "  ")) != "").select(
        "doc_id", (F.col("line") - 1).alias("line_delta"), F.col("start_byte").alias("byte_delta"), F.sha2("line_text", 256).alias("record_hash")
    )


# ---------------------------------------------------------------- first wins, keys, levels


@query("""
SELECT feed, batch_no, file_id, record_id FROM (
  SELECT feed, batch_no, json_extract_string(payload, '$.file_id') AS file_id, record_id,
    row_number() OVER (PARTITION BY feed, batch_no, json_extract_string(payload, '$.file_id') ORDER BY received_at, record_id) AS rn
  FROM (SELECT DISTINCT * FROM raw_exports)) WHERE rn = 1""")
def dedupe_first_wins(s, d):
    raw = table(s, d, "raw_exports").select("feed", "batch_no", F.get_json_object("payload", "$.file_id").alias("file_id"), "record_id", "received_at")
    return integrity.first_wins(raw, ["feed", "batch_no", "file_id"], [F.col("received_at"), F.col("record_id")]).select("feed", "batch_no", "file_id", "record_id")


@query("""
WITH r AS (SELECT DISTINCT json_extract_string(payload, '$.file_id') AS file_id, record_id, received_at, json_extract_string(payload, '$.language') AS language,
  json_extract_string(payload, '$.status') AS status FROM raw_exports),
f AS (SELECT file_id, language AS l1, status AS s1 FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY received_at, record_id) AS rn FROM r) WHERE rn = 1),
c AS (SELECT file_id, count(*) AS claims, bool_or(language IS DISTINCT FROM l1) AS dl, bool_or(status IS DISTINCT FROM s1) AS ds FROM r JOIN f USING (file_id) GROUP BY 1)
SELECT file_id, claims, concat_ws(',', CASE WHEN dl THEN 'language' END, CASE WHEN ds THEN 'status' END) AS diverging FROM c WHERE dl OR ds""")
def site_first_wins_conflicts(s, d):
    g = lambda k: F.get_json_object("payload", f"$.{k}").alias(k)
    raw = table(s, d, "raw_exports").select(g("file_id"), "record_id", "received_at", g("language"), g("status")).distinct()
    out = integrity.conflicts(raw, ["file_id"], [F.col("received_at"), F.col("record_id")], ["language", "status"])
    return out.withColumn("diverging", F.array_join("diverging", ","))


@query("""
SELECT DISTINCT symbol_id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM symbols c WHERE c.parent_symbol_id = s.symbol_id)
  AND NOT EXISTS (SELECT 1 FROM coverage_samples v WHERE v.source_path = s.path)""")
def unshared_sites(s, d):
    """Rows that neither of two tables refers to (two anti joins)."""
    sym = _symbols(s, d, "symbol_id", "path")
    kids = table(s, d, "symbols").select(F.col("parent_symbol_id").alias("symbol_id"))
    seen = table(s, d, "coverage_samples").select(F.col("source_path").alias("path"))
    return sym.join(kids, "symbol_id", "left_anti").join(seen, "path", "left_anti").select("symbol_id").distinct()


@query("""
WITH s AS (SELECT DISTINCT symbol_id, parent_symbol_id FROM symbols)
SELECT 'drop' AS policy, count(*) AS rows, count(parent_symbol_id) AS with_parent FROM s WHERE parent_symbol_id IN (SELECT symbol_id FROM s)
UNION ALL SELECT 'null', count(*), count(CASE WHEN parent_symbol_id IN (SELECT symbol_id FROM s) THEN 1 END) FROM s""")
def fk_drop_vs_null(s, d):
    sym = _symbols(s, d, "symbol_id", "parent_symbol_id")
    count = lambda df, p: df.agg(F.lit(p).alias("policy"), F.count("*").alias("rows"), F.count("parent_symbol_id").alias("with_parent"))
    cols = ["policy", "rows", "with_parent"]
    dropped = integrity.drop_dangling(sym, "parent_symbol_id", sym.select(F.col("symbol_id").alias("pk")), "pk")
    nulled = integrity.null_dangling(sym, "parent_symbol_id", sym.select(F.col("symbol_id").alias("pk")), "pk")
    return count(dropped, "drop").select(*cols).unionByName(count(nulled, "null").select(*cols))


_FKS = (
    ("symbols", "file_id", "files", "file_id"), ("symbols", "parent_symbol_id", "symbols", "symbol_id"),
    ("revision_file_changes", "file_id", "files", "file_id"), ("revision_file_changes", "revision_id", "extraction_revisions", "revision_id"),
    ("extraction_revisions", "parent_revision_id", "extraction_revisions", "revision_id"), ("files", "last_revision_id", "extraction_revisions", "revision_id"),
    ("raw_exports", "revision_id", "extraction_revisions", "revision_id"), ("coverage_samples", "source_path", "files", "path"),
)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}.{f}' AS fk_name, count(*) AS rows, count(*) FILTER (WHERE {f} NOT IN (SELECT {k} FROM {p})) AS dangling FROM {c} WHERE {f} IS NOT NULL"
        for c, f, p, k in _FKS
    )
)
def fk_check(s, d):
    out = None
    for c, f, p, k in _FKS:
        one = integrity.dangling_count(table(s, d, c), f, table(s, d, p), k, f"{c}.{f}")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- spans and scopes

_RANK = """CASE WHEN {k} IN ('function', 'method', 'constructor', 'destructor', 'operator', 'delegate', 'event') THEN 1
  WHEN {k} IN ('class', 'interface', 'struct', 'enum', 'trait', 'union', 'type') THEN 2 WHEN {k} IN ('namespace', 'module') THEN 3
  WHEN {k} IN ('variable', 'constant', 'property', 'field', 'enum_member') THEN 10 ELSE 5 END"""


@query(f"""
WITH s AS (SELECT DISTINCT symbol_id, file_id, kind, start_byte, end_byte FROM symbols),
h AS (SELECT p.symbol_id, c.symbol_id AS container_id, row_number() OVER (PARTITION BY p.symbol_id ORDER BY {_RANK.format(k="c.kind")}, c.end_byte - c.start_byte, c.start_byte, c.symbol_id) AS rn
  FROM s p JOIN s c ON p.file_id = c.file_id AND c.start_byte < p.start_byte AND p.start_byte < c.end_byte)
SELECT s.symbol_id, h.container_id FROM s LEFT JOIN h ON h.symbol_id = s.symbol_id AND h.rn = 1""")
def containing_symbol(s, d):
    sym = _symbols(s, d, "symbol_id", "file_id", "kind", "start_byte", "end_byte")
    return spans.containing(sym, sym, "symbol_id", "start_byte", exclude_start=True)


_ASOF = """
WITH s AS (SELECT DISTINCT symbol_id, file_id, kind, start_byte, end_byte, doc_comment FROM symbols),
p AS (SELECT symbol_id, file_id, {at} AS at FROM s),
t AS (SELECT file_id, {to} AS tb, min(symbol_id) AS tid FROM s WHERE doc_comment IS NOT NULL GROUP BY 1, 2)
SELECT p.symbol_id, t.tid AS target_id FROM p ASOF LEFT JOIN t ON p.file_id = t.file_id AND p.at {op} t.tb"""


@query(_ASOF.format(at="end_byte", to="start_byte", op="<="))
def documented_symbol_following(s, d):
    sym = _symbols(s, d, "symbol_id", "file_id", "kind", "start_byte", "end_byte", "doc_comment")
    t = sym.where("doc_comment is not null")
    return spans.nearest(sym, t, "symbol_id", "end_byte", "symbol_id", "start_byte")


@query(_ASOF.format(at="start_byte", to="end_byte", op=">="))
def documented_symbol_preceding(s, d):
    sym = _symbols(s, d, "symbol_id", "file_id", "kind", "start_byte", "end_byte", "doc_comment")
    t = sym.where("doc_comment is not null")
    return spans.nearest(sym, t, "symbol_id", "start_byte", "symbol_id", "end_byte", following=False)


_CHAINS = """WITH RECURSIVE n AS (SELECT DISTINCT symbol_id AS id, parent_symbol_id AS p, kind, file_id, name FROM symbols),
ok AS (SELECT id FROM n WHERE p IS NULL OR p NOT IN (SELECT id FROM n) UNION ALL SELECT n.id FROM n JOIN ok ON n.p = ok.id),
chain AS (SELECT n.id, n.id AS scope, CAST(0 AS BIGINT) AS distance, n.p FROM n JOIN ok USING (id)
  UNION ALL SELECT c.id, n.id, c.distance + 1, n.p FROM chain c JOIN n ON c.p = n.id)
"""


@query(_CHAINS + "SELECT id AS symbol_id, scope AS scope_id, distance FROM chain")
def scope_chain(s, d):
    return scope.scope_chains(_symbols(s, d, "symbol_id", "parent_symbol_id", "file_id"))


@query(
    _CHAINS
    + """, t AS (SELECT c.id, min_by(c.scope, (c.distance, c.scope)) AS type_id, min(c.distance) AS distance FROM chain c JOIN n ON n.id = c.scope
  WHERE c.distance > 0 AND n.kind IN ('class', 'interface', 'struct', 'enum', 'trait', 'union', 'type') GROUP BY 1)
SELECT n.id AS symbol_id, t.type_id, t.distance FROM n LEFT JOIN t USING (id)"""
)
def enclosing_type(s, d):
    return scope.enclosing_types(_symbols(s, d, "symbol_id", "parent_symbol_id", "file_id", "kind"))


@query(
    _CHAINS
    + """, r AS (SELECT id AS rid, file_id, p AS caller, name FROM n WHERE kind IN ('function', 'method') AND p IS NOT NULL),
vis AS (SELECT r.rid, r.file_id, r.name, c.scope, c.distance FROM r JOIN chain c ON c.id = r.caller UNION ALL SELECT rid, file_id, name, '', 1099511627776 FROM r),
hit AS (SELECT v.rid, v.distance, count(*) AS k, count(*) FILTER (WHERE b.kind IN ('function', 'method')) AS good, min(b.id) AS target
  FROM vis v JOIN n b ON b.file_id = v.file_id AND b.name = v.name AND coalesce(b.p, '') = v.scope GROUP BY 1, 2),
near AS (SELECT rid, arg_min((k, good, target), distance) AS b FROM hit GROUP BY 1)
SELECT r.rid AS reference_id, CASE WHEN b IS NULL THEN 'missing' WHEN b[1] = 1 AND b[2] = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome,
  CASE WHEN b[1] = 1 AND b[2] = 1 THEN b[3] END AS target_id FROM r LEFT JOIN near USING (rid)"""
)
def resolve_nearest_binding(s, d):
    """Each nested function's name resolved from its parent's scope."""
    sym = _symbols(s, d, "symbol_id", "parent_symbol_id", "file_id", "kind", "name")
    refs = sym.where("kind in ('function', 'method') and parent_symbol_id is not null").select(
        F.col("symbol_id").alias("reference_id"), "file_id", F.col("parent_symbol_id").alias("caller_id"), "name"
    )
    return scope.resolve_nearest(refs, sym, ("function", "method"))


@query("""SELECT file_id, name, min(symbol_id) AS symbol_id FROM (SELECT DISTINCT file_id, name, symbol_id FROM symbols) GROUP BY 1, 2 HAVING count(*) = 1""")
def unique_by_name(s, d):
    return scope.unique_names(table(s, d, "symbols"), "file_id")


@query("""
SELECT s.symbol_id, s.name, s.language, s.kind, s.start_line, s.end_line - s.start_line + 1 AS covered_lines FROM (SELECT DISTINCT symbol_id, name, language, kind, start_line, end_line FROM symbols) s
WHERE s.kind IN ('function', 'method', 'constructor') AND s.end_line - s.start_line >= 8""")
def point_lookup(s, d):
    return _symbols(s, d, "symbol_id", "name", "language", "kind", "start_line", "end_line").where("kind in ('function', 'method', 'constructor') and end_line - start_line >= 8").select(
        "symbol_id", "name", "language", "kind", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("covered_lines")
    )


@query("""
SELECT path, language, count(*) AS symbols, count(*) FILTER (WHERE kind IN ('function', 'method', 'constructor')) AS callables,
  sum(end_line - start_line + 1)::BIGINT AS covered_lines, min(start_byte) AS start_byte, max(end_byte) AS end_byte
FROM (SELECT DISTINCT symbol_id, path, language, kind, start_line, end_line, start_byte, end_byte FROM symbols) GROUP BY 1, 2""")
def complexity_file_merge(s, d):
    sym = _symbols(s, d, "symbol_id", "path", "language", "kind", "start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")
    return sym.groupBy("path", "language").agg(
        F.count("*").alias("symbols"), F.count_if(F.col("kind").isin("function", "method", "constructor")).alias("callables"),
        F.sum(F.col("end_line") - F.col("start_line") + 1).alias("covered_lines"), *reports.hull(),
    ).drop("hull_start", "hull_end")


# ---------------------------------------------------------------- bodies, literals, routes, markers


@query("""
SELECT body_hash, count(DISTINCT symbol_id) AS clones, min(symbol_id) AS representative FROM symbols WHERE body_hash IS NOT NULL GROUP BY 1""")
def body_hash_groups(s, d):
    return table(s, d, "symbols").where("body_hash is not null").groupBy("body_hash").agg(
        F.countDistinct("symbol_id").alias("clones"), F.min("symbol_id").alias("representative")
    )


_TOK = r"""'"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'"""


@query(rf"""
SELECT DISTINCT file_id, md5(array_to_string(regexp_extract_all(regexp_replace(content, '(?s)/\*.*?\*/', ' ', 'g'), {_TOK}), chr(31))) AS token_hash FROM file_snapshots""")
def token_hashes(s, d):
    c = F.regexp_replace("content", r"(?s)/\*.*?\*/", " ")
    return table(s, d, "file_snapshots").select(
        "file_id", F.md5(F.array_join(F.regexp_extract_all(c, F.lit(text.TOKEN), F.lit(0)), "\x1f")).alias("token_hash")
    ).distinct()


@query(r"""
WITH m AS (SELECT DISTINCT file_id, language, content FROM file_snapshots),
x AS (SELECT file_id, language, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_.]*)\("([^"\\\n]*)"', 1)) AS carrier,
  unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_.]*)\("([^"\\\n]*)"', 2)) AS literal FROM m)
SELECT language, carrier, CASE WHEN carrier IN ('report', 'log.info') THEN 'message' WHEN carrier IN ('fetch', 'get') THEN 'url' END AS kind, count(*) AS n,
  count(DISTINCT literal) AS texts FROM x GROUP BY 1, 2, 3""")
def literal_carriers(s, d):
    p = r'([A-Za-z_][A-Za-z0-9_.]*)\("([^"\\\n]*)"'
    m = table(s, d, "file_snapshots").select("file_id", "language", "content").distinct()
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("carrier"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("literal"))
    x = m.select("language", F.explode(both).alias("x")).select("language", "x.carrier", "x.literal")
    kind = F.when(F.col("carrier").isin("report", "log.info"), "message").when(F.col("carrier").isin("fetch", "get"), "url")
    return x.groupBy("language", "carrier", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("literal").alias("texts"))


_ROUTES = [
    ("users/{id}", "braces", "/users/:id"), ("/users/{id:int}/posts/{**rest}", "braces", "/users/:id/posts/:rest"), ("/a/:b?/c", "colon", "/a/:b/c"),
    ("/files/<path:name>/", "angle", "/files/:name"), ("/blog/[slug]/[...rest]", "brackets", "/blog/:slug/:rest"), ("^articles/(?P<year>[0-9]{4})/$", "regex", "/articles/:year"), ("/", "colon", "/"),
]


@query(
    "SELECT template, route, len(regexp_extract_all(route, ':([A-Za-z_]\\w*)', 1)) AS dynamic FROM (VALUES "
    + ", ".join(f"('{a}', '{c}')" for a, _, c in _ROUTES)
    + ") v(template, route)"
)
def route_normalize(s, d):
    df = s.createDataFrame([(a, b) for a, b, _ in _ROUTES], "template string, flavour string")
    r = text.normalize_route(F.col("template"), F.col("flavour"))
    return df.select("template", r.alias("route"), F.size(text.dynamic_segments(r)).cast("long").alias("dynamic"))


@query("""
WITH u AS (SELECT path AS url FROM files UNION ALL SELECT '/' || path FROM files UNION ALL SELECT 'https://host/' || path || '?v=1#top' FROM files)
SELECT url, CASE WHEN url LIKE 'https://%' THEN 'absolute' WHEN url LIKE '/%' THEN 'path' ELSE 'relative' END AS kind,
  regexp_replace(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '\\.[^.]*$', '') AS stem FROM u""")
def url_kinds(s, d):
    p = table(s, d, "files").select("path")
    u = p.select(F.explode(F.array("path", F.concat(F.lit("/"), "path"), F.concat(F.lit("https://host/"), "path", F.lit("?v=1#top")))).alias("url"))
    return u.select("url", text.url_kind(F.col("url")).alias("kind"), text.document_stem(F.col("url")).alias("stem"))


@query(r"""
WITH f AS (SELECT DISTINCT file_id, content FROM file_snapshots), l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS t FROM f),
c AS (SELECT file_id, regexp_replace(trim(t, ' ' || chr(9) || chr(13)), '^(///?|//!|/\*\*?|#+)\s*', '') AS b FROM l WHERE regexp_matches(trim(t, ' ' || chr(9) || chr(13)), '^(//|#|/\*)'))
SELECT file_id, regexp_extract(b, '^(TODO|FIXME|HACK|XXX)', 1) AS marker, count(*) AS n FROM c WHERE regexp_matches(b, '^(TODO|FIXME|HACK|XXX)(\(|[:\s-]|$)') GROUP BY 1, 2""")
def comment_markers(s, d):
    """Markers in lines that begin like a comment, in all files; equal lines of a file count each."""
    src = table(s, d, "file_snapshots").select("file_id", "content").distinct()
    ls = src.select("file_id", F.explode(F.split("content", "\n")).alias("t")).select("file_id", F.trim(F.translate("t", "\t\r", "  ")).alias("t"))
    c = ls.where(F.col("t").rlike(r"^(//|#|/\*)")).select("file_id", F.regexp_replace("t", r"^(///?|//!|/\*\*?|#+)\s*", "").alias("b"))
    c = c.where(F.col("b").rlike(r"^(TODO|FIXME|HACK|XXX)(\(|[:\s-]|$)"))
    return c.groupBy("file_id", F.regexp_extract("b", r"^(TODO|FIXME|HACK|XXX)", 1).alias("marker")).agg(F.count("*").alias("n"))


@query("""
SELECT k AS field, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || k)) AS distinct_values FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1""")
def json_properties(s, d):
    e = table(s, d, "events").select("props", F.explode(F.json_object_keys("props")).alias("field"))
    v = F.from_json("props", "map<string,string>")[F.col("field")]
    return e.select("field", v.alias("v")).groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("v").alias("distinct_values"))


# ---------------------------------------------------------------- outlines

_HEADS = r"""
WITH p AS (SELECT DISTINCT file_id, string_split(content, chr(10)) AS l FROM file_snapshots WHERE language = 'markdown'),
x AS (SELECT file_id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM p),
f AS (SELECT *, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte,
  sum(CASE WHEN regexp_matches(t, '^ {0,3}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line) AS fences FROM x),
h AS (SELECT file_id, line, CAST(start_byte AS BIGINT) AS start_byte, CAST(length(regexp_extract(t, '^ {0,3}(#{1,6})', 1)) AS BIGINT) AS level,
  trim(regexp_replace(regexp_extract(t, '^ {0,3}#{1,6}[ \t]*([^\r]*)', 1), '[ \t]+#+[ \t]*$', '')) AS title
  FROM f WHERE fences % 2 = 0 AND regexp_matches(t, '^ {0,3}#{1,6}([ \t]|\r?$)'))
"""


def _headings(s, d):
    md = table(s, d, "file_snapshots").where("language = 'markdown'").select("file_id", "content").distinct()
    return outline.headings(md, "file_id", "content")


@query(_HEADS + "SELECT file_id, line, start_byte, level, title FROM h")
def markdown_headings(s, d):
    return _headings(s, d)


@query(
    _HEADS
    + """SELECT a.file_id, a.line, a.level, (SELECT min(b.line) FROM h b WHERE b.file_id = a.file_id AND b.line > a.line AND b.level <= a.level) AS section_end,
  (SELECT max(b.line) FROM h b WHERE b.file_id = a.file_id AND b.line < a.line AND b.level < a.level) AS parent_line FROM h a"""
)
def heading_outline(s, d):
    return outline.sections(_headings(s, d), "file_id").select("file_id", "line", "level", "section_end", "parent_line")


@query(
    _HEADS
    + r""", g AS (SELECT file_id, line, regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}\s_-]', '', 'g'), '\s', '-', 'g') AS slug FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id, slug ORDER BY line) - 1 AS n FROM g)
SELECT file_id, line, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor FROM k"""
)
def heading_anchors(s, d):
    return outline.anchors(_headings(s, d), "file_id").select("file_id", "line", "anchor")


# ---------------------------------------------------------------- totals, attribution, diffs, incremental

_TABLES = ("consumer_runs", "coverage_samples", "customer", "documents", "events", "extraction_revisions", "file_snapshots", "files", "lineitem", "mixture_targets", "nation", "orders", "part", "raw_exports", "region", "revision_file_changes", "supplier", "symbols")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES))
def table_totals(s, d):
    return reports.table_totals({t: table(s, d, t) for t in _TABLES})


_ATTR = """
WITH c AS (SELECT file_id, 'changes' AS k FROM revision_file_changes UNION ALL SELECT file_id, 'snapshots' FROM file_snapshots UNION ALL SELECT file_id, 'symbols' FROM symbols),
g AS (SELECT file_id, count(*) FILTER (WHERE k = 'changes') AS changes, count(*) FILTER (WHERE k = 'snapshots') AS snapshots, count(*) FILTER (WHERE k = 'symbols') AS symbols, count(*) AS total_rows FROM c GROUP BY 1)
SELECT f.file_id, f.path, f.language, coalesce(changes, 0) AS changes, coalesce(snapshots, 0) AS snapshots, coalesce(symbols, 0) AS symbols, coalesce(total_rows, 0) AS total_rows
FROM files f LEFT JOIN g USING (file_id)"""


def _attributed(s, d):
    files = table(s, d, "files").select("file_id", "path", "language")
    return reports.attribution(files, {"changes": table(s, d, "revision_file_changes"), "snapshots": table(s, d, "file_snapshots"), "symbols": table(s, d, "symbols")})


@query(_ATTR)
def info_file_rows(s, d):
    return _attributed(s, d)


@query(_ATTR + " ORDER BY total_rows DESC, path LIMIT 20")
def file_row_attribution_top20(s, d):
    return reports.top_files(_attributed(s, d), 20)


_SUPPORTED = "language IN ('go', 'java', 'rust', 'python', 'json', 'toml', 'javascript')"
_DIFF = f"""
WITH o AS (SELECT file_id, max(sha256(content)) AS h FROM file_snapshots WHERE NOT ends_with(file_id, '0') GROUP BY 1),
n AS (SELECT file_id, max(CASE WHEN ends_with(file_id, '1') THEN 'changed' ELSE sha256(content) END) AS h, min(language) AS language FROM file_snapshots WHERE NOT ends_with(file_id, '2') GROUP BY 1)
"""
_KIND = f"CASE WHEN n.file_id IS NULL THEN 'deleted' WHEN NOT (n.{_SUPPORTED}) THEN 'unsupported' WHEN o.file_id IS NULL THEN 'inserted' WHEN o.h <> n.h THEN 'updated' END"


def _states(s, d):
    """Two states of the tree: files ending in 0 are new, in 1 changed, in 2 gone."""
    snap = table(s, d, "file_snapshots").groupBy("file_id").agg(F.max(F.sha2("content", 256)).alias("content_hash"), F.min("language").alias("language"))
    old = snap.where(~F.col("file_id").endswith("0"))
    new = snap.where(~F.col("file_id").endswith("2")).withColumn("content_hash", F.when(F.col("file_id").endswith("1"), "changed").otherwise(F.col("content_hash")))
    return old, new


@query(_DIFF + f"SELECT coalesce(o.file_id, n.file_id) AS file_id, {_KIND} AS change_kind FROM o FULL JOIN n USING (file_id) WHERE {_KIND} IS NOT NULL")
def revision_diff(s, d):
    old, new = _states(s, d)
    return reports.revision_diff(old, new, F.expr(_SUPPORTED))


@query("""
WITH c AS (SELECT language, count(*) AS files, sum(content_bytes)::BIGINT AS bytes FROM files WHERE status <> 'unsupported' GROUP BY 1), w AS (SELECT language, count(DISTINCT file_id) AS files, sum(content_bytes)::BIGINT AS bytes FROM (SELECT DISTINCT file_id, language, content_bytes FROM file_snapshots) WHERE language <> 'toml' GROUP BY 1)
SELECT language, w.files, w.bytes, CASE WHEN w.files IS NULL THEN 'delete' WHEN c.files IS NULL THEN 'insert' WHEN c.files IS NOT DISTINCT FROM w.files AND c.bytes IS NOT DISTINCT FROM w.bytes THEN 'keep' ELSE 'update' END AS action FROM c FULL JOIN w USING (language)""")
def capability_sync(s, d):
    """Languages recorded in ``files`` mirrored from the snapshots (here without TOML): only what differs changes."""
    sums = [F.count("*").alias("files"), F.sum("content_bytes").cast("long").alias("bytes")]
    cur = table(s, d, "files").where("status <> 'unsupported'").groupBy("language").agg(*sums)
    new = table(s, d, "file_snapshots").where("language <> 'toml'").select("file_id", "language", "content_bytes").distinct().groupBy("language").agg(*sums)
    return integrity.sync_snapshot(cur, new, ["language"])


@query("""SELECT 'symbol' AS source, symbol_id AS id FROM symbols UNION ALL SELECT 'change', file_id FROM revision_file_changes""")
def occurrence_union(s, d):
    a = table(s, d, "symbols").select(F.lit("symbol").alias("source"), F.col("symbol_id").alias("id"))
    return a.unionByName(table(s, d, "revision_file_changes").select(F.lit("change").alias("source"), F.col("file_id").alias("id")))


@query("""SELECT r.input_root, count(*) AS rows, count(DISTINCT c.file_id) AS files, count(DISTINCT c.revision_id) AS revisions FROM revision_file_changes c JOIN (SELECT DISTINCT revision_id, input_root FROM extraction_revisions) r USING (revision_id) GROUP BY 1""")
def distinct_sites(s, d):
    r = table(s, d, "extraction_revisions").select("revision_id", "input_root").distinct()
    return table(s, d, "revision_file_changes").join(r, "revision_id").groupBy("input_root").agg(
        F.count("*").alias("rows"), F.countDistinct("file_id").alias("files"), F.countDistinct("revision_id").alias("revisions")
    )


@query("""
WITH o AS (SELECT file_id, status, language FROM files), n AS (SELECT file_id, CASE WHEN ends_with(file_id, '3') THEN 'stale' ELSE status END AS status, language FROM files WHERE NOT ends_with(file_id, '4'))
SELECT *, 'removed' AS side FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT *, 'added' FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)""")
def artifact_diff(s, d):
    """Two states of an artifact compared as multisets, the time stamp left out."""
    old = table(s, d, "files").select("file_id", "status", "language", "indexed_at")
    new = old.where(~F.col("file_id").endswith("4")).withColumn("status", F.when(F.col("file_id").endswith("3"), "stale").otherwise(F.col("status")))
    return integrity.difference(old, new, volatile=("indexed_at",))


@query("""
SELECT v.source_path, count(DISTINCT s.symbol_id) AS found, count(DISTINCT s.symbol_id) >= 1 AS passed FROM (SELECT DISTINCT source_path FROM coverage_samples WHERE list_contains(expected_domains, 'symbols')) v
LEFT JOIN symbols s ON s.path = v.source_path GROUP BY 1""")
def fact_assertions(s, d):
    want = table(s, d, "coverage_samples").where(F.array_contains("expected_domains", "symbols")).select(F.col("source_path").alias("path")).distinct()
    got = want.join(table(s, d, "symbols").select("path", "symbol_id"), "path", "left").groupBy(F.col("path").alias("source_path")).agg(F.countDistinct("symbol_id").alias("found"))
    return got.withColumn("passed", F.col("found") >= 1)


@query("""SELECT language, domain, count(*) AS samples FROM (SELECT language, unnest(expected_domains) AS domain FROM coverage_samples) GROUP BY 1, 2""")
def observed_counts(s, d):
    return table(s, d, "coverage_samples").select("language", F.explode("expected_domains").alias("domain")).groupBy("language", "domain").agg(F.count("*").alias("samples"))


@query("""
WITH r AS (SELECT DISTINCT revision_id, operation, epoch_us(try_cast(completed_at AS TIMESTAMPTZ)) - epoch_us(try_cast(started_at AS TIMESTAMPTZ)) AS us FROM extraction_revisions)
SELECT operation, min(us) AS lowest, round(quantile_cont(us, 0.5), 3) AS middle, max(us) AS highest, count(*) AS n FROM r WHERE us IS NOT NULL GROUP BY 1""")
def perf_summary(s, d):
    """Least, middle and longest duration of the revisions, in microseconds, by operation."""
    r = table(s, d, "extraction_revisions")
    r = r.select("revision_id", "operation", (utc_micros(r, "completed_at") - utc_micros(r, "started_at")).alias("us")).distinct().where("us is not null")
    return r.groupBy("operation").agg(*reports.summary("us"), F.count("*").alias("n")).withColumn("middle", F.round("middle", 3))


@query("""SELECT language, kind, visibility, count(*) AS n, grouping(language, kind, visibility) AS level FROM symbols GROUP BY GROUPING SETS ((language, kind, visibility), (language), ())""")
def resolution_coverage_rollup(s, d):
    t = table(s, d, "symbols").select("language", "kind", "visibility")
    l, k, v = F.col("language"), F.col("kind"), F.col("visibility")
    return t.groupingSets([(l, k, v), (l,), ()], "language", "kind", "visibility").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""
SELECT max(revision_id) AS latest_revision, count(DISTINCT revision_id) AS revisions, count(DISTINCT revision_id) FILTER (WHERE completed_at IS NULL OR completed_at = '') AS uncommitted,
  sum(CAST(json_extract(counts_json, '$.files_changed') AS BIGINT))::BIGINT AS files_changed FROM (SELECT DISTINCT revision_id, completed_at, counts_json FROM extraction_revisions)""")
def latest_revision(s, d):
    r = table(s, d, "extraction_revisions").select("revision_id", "completed_at", "counts_json").distinct()
    open_ = F.col("completed_at").isNull() | (F.col("completed_at") == "")
    return r.agg(
        F.max("revision_id").alias("latest_revision"), F.countDistinct("revision_id").alias("revisions"), F.countDistinct(F.when(open_, F.col("revision_id"))).alias("uncommitted"),
        F.sum(F.get_json_object("counts_json", "$.files_changed").cast("long")).alias("files_changed"),
    )


@query("""
SELECT language, domains, count(*) AS samples FROM (SELECT language, array_to_string(list_sort(list_distinct(expected_domains)), ',') AS domains FROM coverage_samples) GROUP BY 1, 2""")
def domain_proofs(s, d):
    dom = F.array_join(F.array_sort(F.array_distinct("expected_domains")), ",")
    return table(s, d, "coverage_samples").groupBy("language", dom.alias("domains")).agg(F.count("*").alias("samples"))


@query("""SELECT v.source_path, v.source_sha256 = sha256(s.content) AS fresh FROM coverage_samples v JOIN (SELECT DISTINCT path, content FROM file_snapshots) s ON s.path = v.source_path""")
def pinned_sources(s, d):
    snap = table(s, d, "file_snapshots").select(F.col("path").alias("source_path"), "content").distinct()
    return table(s, d, "coverage_samples").join(snap, "source_path").select("source_path", (F.col("source_sha256") == F.sha2("content", 256)).alias("fresh"))


@query("""
SELECT DISTINCT 'text:' || file_id || chr(9) || CASE WHEN line_count IS NULL THEN 'null:' ELSE 'int:' || line_count END || chr(9) || 'text:' || status AS row FROM files""")
def dump_table(s, d):
    r = lambda c, k: ids.render_value(F.col(c), k)
    return table(s, d, "files").select(F.concat_ws("\t", r("file_id", "string"), r("line_count", "bigint"), r("status", "string")).alias("row")).distinct()


@query("""
WITH RECURSIVE t AS (SELECT '0' AS ord, '' AS parent, '{"name":"Map","args":[{"name":"String"},{"name":"List","args":[{"name":"User"}]}]}'::JSON AS n
  UNION ALL SELECT ord || '.' || (i - 1), ord, json_extract(n, '$.args[' || (i - 1) || ']') FROM t, range(1, CAST(coalesce(json_array_length(n, '$.args'), 0) + 1 AS BIGINT)) g(i))
SELECT ord AS path, parent, json_extract_string(n, '$.name') AS type_name FROM t""")
def type_arguments_flatten(s, d):
    """Nested generic arguments in pre-order with their place and parent."""
    df = s.createDataFrame([("Map<String, List<User>>",)], "type string")
    return generics.flatten(df, "type").select("path", "parent", "type_name")


# ---------------------------------------------------------------- consumer SQL on the artifact and other tables


@query("""
SELECT f.language, s.kind, count(*) AS n, count(*) FILTER (WHERE s.is_test) AS tests FROM symbols s JOIN files f ON f.file_id = s.file_id GROUP BY 1, 2""")
def consumer_join(s, d):
    for t in ("symbols", "files"):
        table(s, d, t).createOrReplaceTempView(f"v_{t}")
    return s.sql("SELECT f.language, s.kind, count(*) AS n, count_if(s.is_test) AS tests FROM v_symbols s JOIN v_files f ON f.file_id = s.file_id GROUP BY 1, 2")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def consumer_aggregate(s, d):
    return table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query("""
SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3""")
def consumer_top_k(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("""
SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def consumer_star(s, d):
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return o.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# ---------------------------------------------------------------- re-homing, rekeying, audits

_ONE = "SELECT symbol_id, min(parent_symbol_id) AS parent, min(kind) AS kind FROM symbols GROUP BY 1"


@query(f"""
WITH RECURSIVE n AS ({_ONE}), good AS (
  SELECT symbol_id, parent, kind, CAST(NULL AS VARCHAR) AS near FROM n WHERE parent IS NULL OR parent NOT IN (SELECT symbol_id FROM n)
  UNION ALL SELECT n.symbol_id, n.parent, n.kind, CASE WHEN g.kind IN ('class', 'trait', 'interface') THEN g.near ELSE g.symbol_id END FROM n JOIN good g ON n.parent = g.symbol_id)
SELECT n.symbol_id, g.near AS parent_symbol_id FROM n LEFT JOIN good g USING (symbol_id) WHERE n.kind NOT IN ('class', 'trait', 'interface')""")
def symbols_rehomed(s, d):
    """Symbols without classes, traits and interfaces, each below its nearest kept ancestor."""
    return scope.retain(_symbols(s, d, "symbol_id", "parent_symbol_id", "file_id", "kind"), ~F.col("kind").isin("class", "trait", "interface"))


@query("""
WITH s AS (SELECT DISTINCT symbol_id, parent_symbol_id, file_id FROM symbols), m AS (SELECT symbol_id AS old, min(md5(symbol_id || file_id)) AS new FROM s GROUP BY 1)
SELECT a.new AS symbol_id, coalesce(b.new, s.parent_symbol_id) AS parent_symbol_id FROM s JOIN m a ON a.old = s.symbol_id LEFT JOIN m b ON b.old = s.parent_symbol_id""")
def symbols_rekeyed(s, d):
    """New symbol ids, and the parents rewritten through the map of old to new ids."""
    t = {"symbols": _symbols(s, d, "symbol_id", "parent_symbol_id", "file_id")}
    new = F.md5(F.concat("symbol_id", "file_id"))
    return integrity.rekey(t, "symbols", "symbol_id", new, [("symbols", "parent_symbol_id")])["symbols"].select("symbol_id", "parent_symbol_id")


@query("""
WITH f AS (SELECT file_id, max(content) AS content FROM file_snapshots GROUP BY 1), s AS (SELECT DISTINCT symbol_id, file_id, name, start_byte, end_byte FROM symbols)
SELECT symbol_id, CASE WHEN f.content IS NULL THEN 'no_file' WHEN start_byte < 0 OR end_byte < start_byte OR end_byte > strlen(f.content) THEN 'outside'
  WHEN position(s.name IN decode(encode(f.content)[start_byte + 1 : end_byte])) > 0 THEN 'holds' ELSE 'differs' END AS verdict FROM s LEFT JOIN f USING (file_id)""")
def span_matches(s, d):
    """Whether the bytes of each symbol's span hold its name."""
    one = table(s, d, "file_snapshots").groupBy("file_id").agg(F.max("content").alias("content"))
    return audit.span_check(_symbols(s, d, "symbol_id", "file_id", "name", "start_byte", "end_byte"), one, "name").select("symbol_id", "verdict")


@query("""
SELECT source_path AS path, 'missing' AS side FROM (SELECT DISTINCT source_path FROM coverage_samples) WHERE source_path NOT IN (SELECT path FROM files)
UNION ALL SELECT path, 'unlisted' FROM (SELECT DISTINCT path FROM files) WHERE path NOT IN (SELECT source_path FROM coverage_samples WHERE source_path IS NOT NULL)""")
def registry_reconciled(s, d):
    """Samples without a file, and files without a sample."""
    return audit.reconcile(table(s, d, "coverage_samples").select(F.col("source_path").alias("path")), table(s, d, "files"), "path")


_CLAIMS = "SELECT language, unnest(expected_domains) AS domain, CASE WHEN expected_parse_diagnostics IS NULL THEN 'unknown' WHEN expected_parse_diagnostics = 0 THEN 'clean' ELSE 'damaged' END AS bucket FROM coverage_samples"


def _claims(s, d):
    n = F.col("expected_parse_diagnostics")
    return table(s, d, "coverage_samples").select("language", F.explode("expected_domains").alias("domain"), F.when(n.isNull(), "unknown").when(n == 0, "clean").otherwise("damaged").alias("bucket"))


@query(f"SELECT language, domain, array_to_string(list_sort(list(DISTINCT bucket)), ',') AS buckets FROM ({_CLAIMS}) GROUP BY 1, 2 HAVING count(DISTINCT bucket) <> 1")
def claim_conflicts(s, d):
    """Languages and domains that samples put into more than one bucket."""
    return audit.claim_conflicts(_claims(s, d), ["language", "domain"], "bucket").withColumn("buckets", F.array_join("buckets", ","))


@query(f"""SELECT domain, {", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT language) FILTER (WHERE bucket = '{b}')), ','), '') AS {b}" for b in ("clean", "damaged", "unknown"))} FROM ({_CLAIMS}) GROUP BY 1""")
def applicability_view(s, d):
    """The languages of every domain by bucket."""
    out = audit.by_bucket(_claims(s, d), "domain", "bucket", "language", ["clean", "damaged", "unknown"])
    return out.select("domain", *[F.array_join(b, ",").alias(b) for b in ("clean", "damaged", "unknown")])


@query("SELECT language, count(*) AS cells, count(*) - count(expected_parse_diagnostics) AS open FROM coverage_samples GROUP BY 1")
def open_gaps(s, d):
    """Samples whose diagnostics nobody has counted, by language."""
    return audit.open_gaps(table(s, d, "coverage_samples"), "language", "expected_parse_diagnostics")


@query("""
WITH a AS (SELECT file_id, language, content_bytes FROM files), b AS (SELECT file_id, max(language) AS language, max(content_bytes) AS content_bytes FROM file_snapshots GROUP BY 1)
SELECT file_id, '*' AS "column" FROM a FULL JOIN b USING (file_id) WHERE a.language IS NULL OR b.language IS NULL
UNION ALL SELECT file_id, 'language' FROM a JOIN b USING (file_id) WHERE a.language IS DISTINCT FROM b.language
UNION ALL SELECT file_id, 'content_bytes' FROM a JOIN b USING (file_id) WHERE a.content_bytes IS DISTINCT FROM b.content_bytes""")
def receipts_compared(s, d):
    """Where the recorded files and their snapshots differ in language or size."""
    a = table(s, d, "files").select("file_id", "language", "content_bytes", "indexed_at")
    b = table(s, d, "file_snapshots").groupBy("file_id").agg(F.max("language").alias("language"), F.max("content_bytes").alias("content_bytes"))
    return audit.receipts_differ(a, b, "file_id", identity=("indexed_at",))


@query("""
SELECT 'binary_version' AS "column", count(DISTINCT coalesce(binary_version, '?')) AS "values", count(DISTINCT coalesce(binary_version, '?')) <= 1 AS stable FROM extraction_revisions
UNION ALL SELECT 'sqlite_schema_version', count(DISTINCT coalesce(CAST(sqlite_schema_version AS VARCHAR), '?')), count(DISTINCT coalesce(CAST(sqlite_schema_version AS VARCHAR), '?')) <= 1 FROM extraction_revisions""")
def evidence_stable(s, d):
    """Whether all revisions agree on their versions."""
    return audit.stable_evidence(table(s, d, "extraction_revisions"), ["binary_version", "sqlite_schema_version"])


@query("""
WITH l AS (SELECT DISTINCT content FROM file_snapshots WHERE language = 'json' AND json_valid(content)), r AS (SELECT DISTINCT unnest(regexp_extract_all(content, '"(?:[^"\\\\]|\\\\.)*"', 0)) AS raw FROM l)
SELECT raw, json_extract_string(raw, '$') AS value FROM r""")
def string_values(s, d):
    """The distinct string literals of JSON texts that parse, decoded."""
    good = table(s, d, "file_snapshots").where("language = 'json' and try_parse_json(content) is not null").select("content").distinct()
    raw = good.select(F.explode(F.regexp_extract_all("content", F.lit(text.QUOTED), F.lit(0))).alias("raw")).distinct()
    return raw.select("raw", text.string_value(F.col("raw")).alias("value"))


@query("""
WITH p AS (SELECT DISTINCT '/' || split_part(path, '/', 1) || CASE WHEN length(path) % 2 = 0 THEN '/' ELSE '' END AS prefix, CASE WHEN length(path) % 3 = 0 THEN '/' ELSE '' END || split_part(path, '/', 2) AS route FROM files)
SELECT prefix, route, CASE WHEN route = '' THEN prefix ELSE rtrim(prefix, '/') || '/' || ltrim(route, '/') END AS joined FROM p""")
def route_prefixes(s, d):
    """Router prefixes and route templates (here from paths, with and without slashes) joined."""
    n = F.length("path")
    p = table(s, d, "files").select(
        F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1)), F.when(n % 2 == 0, "/").otherwise("")).alias("prefix"),
        F.concat(F.when(n % 3 == 0, "/").otherwise(""), F.split_part("path", F.lit("/"), F.lit(2))).alias("route"),
    ).distinct()
    return p.withColumn("joined", text.join_route(F.col("prefix"), F.col("route")))
