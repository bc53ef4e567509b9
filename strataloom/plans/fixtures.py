"""Queries over small inline sources: what the test tables hold none of (HTML, SQL, routes and clients, encodings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.extract.engine import extract, family
from strataloom.functions.text import normalize_route
from strataloom.sources.snapshot import snapshots

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

SOURCES = [
    ("page.html", "html", '<main><a href="/users/7">u</a><form action="/save"><input name="n"></form><script src="/app.js"></script><img src="/i.png"></main><!-- <a href="/no"> -->\n'),
    ("schema.sql", "sql", "CREATE TABLE users (id int PRIMARY KEY, name text);\nCREATE VIEW v AS WITH a AS (SELECT 1) SELECT * FROM users u LEFT JOIN a ON true;\n-- CREATE TABLE no (id int);\nINSERT INTO users VALUES (1, 'CREATE TABLE x');\n"),
    ("app.py", "python", "from flask import Flask\napp = Flask(__name__)\n\n@app.route('/users/<int:id>')\ndef user(id):\n    count = id\n    count += 1\n    return count\n"),
    ("client.js", "javascript", "export async function load(id) {\n  const r = await fetch('/users/{id}');\n  return r;\n}\n"),
    ("server.go", "go", 'package s\n\nfunc Routes(r *gin.Engine) {\n\tr.GET("/users/:id", get)\n\tdefer done()\n}\n'),
    ("ci.yml", "yaml", "on: [push]\njobs:\n  build:\n    runs-on: x\n    steps:\n      - uses: a/b@v1\n"),
    ("pom.xml", "xml", '<?xml version="1.0"?>\n<project xmlns="http://maven"><add key="a" value="b"/></project>\n'),
    ("style.css", "css", "@import 'a.css';\n:root { --x: 1px; }\n@media (min-width: 1px) { .a { color: red; } }\n"),
    ("broken.py", "python", "def f(:\n    pass\n"),
    ("broken.go", "go", "package p\nfunc f() {\n"),
]


def _extracted(s: SparkSession, level: str = "full") -> DataFrame:
    df = s.createDataFrame([(p, p, l, t) for p, l, t in SOURCES], "file_id string, path string, language string, text string")
    return extract(df, level)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def _values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS BIGINT)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


@query(_values([("html.form.v1", 1), ("html.form_control.v1", 1), ("html.landmark.v1", 1), ("html.link.v1", 1), ("html.media.v1", 1), ("html.script.v1", 1)], "pattern_id, n"))
def html_facts(s, d):
    """Document facts outside comments."""
    f = family(_extracted(s, "facts"), "structural_facts").where("path = 'page.html' and pattern_id like 'html.%'")
    return f.groupBy("pattern_id").agg(F.count("*").alias("n"))


@query(_values([("sql.cte.v1", 1), ("sql.insert_statement.v1", 1), ("sql.join.v1", 1), ("sql.select_query.v1", 2), ("sql.table_definition.v1", 1), ("sql.view_definition.v1", 1)], "pattern_id, n"))
def sql_structure(s, d):
    """Statements and clauses, not those in comments or strings."""
    kinds = ("sql.cte.v1", "sql.insert_statement.v1", "sql.join.v1", "sql.select_query.v1", "sql.table_definition.v1", "sql.view_definition.v1")
    f = family(_extracted(s, "facts"), "structural_facts").where(F.col("pattern_id").isin(*kinds) & (F.col("path") == "schema.sql"))
    return f.groupBy("pattern_id").agg(F.count("*").alias("n"))


@query(_values([("count", "read", 1), ("count", "read_write", 1), ("count", "write", 1), ("id", "read", 1)], "name, access, n"))
def python_access(s, d):
    i = family(_extracted(s), "identifiers").where("path = 'app.py' and name in ('count', 'id') and start_line > 5")
    return i.groupBy("name", F.get_json_object("metadata_json", "$.access").alias("access")).agg(F.count("*").alias("n"))


@query(_values([("broken.go", "missing"), ("broken.py", "error")], "path, kind"))
def syntax_check(s, d):
    return family(_extracted(s, "symbols"), "parse_diagnostics").select("path", "kind")


@query(_values([("client.js", "app.py", "/users/:id"), ("client.js", "server.go", "/users/:id")], "client, server, route"))
def http_boundary_join(s, d):
    """Client requests meet routes on the normalised template (an equi-join)."""
    f = family(_extracted(s, "facts"), "structural_facts").select("path", "pattern_id", F.get_json_object("metadata_json", "$.path").alias("template"))
    flavour = F.when(F.col("pattern_id").startswith("flask"), "angle").when(F.col("pattern_id").startswith("http"), "braces").otherwise("colon")
    f = f.where("template is not null").select("path", "pattern_id", normalize_route(F.col("template"), flavour).alias("route"))
    clients = f.where("pattern_id = 'http.client_request.v1'").select(F.col("path").alias("client"), "route")
    routes = f.where("pattern_id like '%.route.v1'").select(F.col("path").alias("server"), "route")
    return clients.join(routes, "route").select("client", "server", "route").distinct()


@query(_values([("yaml.ci_job.v1", "build"), ("yaml.ci_trigger.v1", "[push]"), ("yaml.ci_uses.v1", "a/b@v1")], "pattern_id, value"))
def ci_facts(s, d):
    f = family(_extracted(s, "facts"), "structural_facts").where("path = 'ci.yml' and pattern_id like 'yaml.ci_%'")
    g = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    return f.select("pattern_id", F.coalesce(g("name"), g("events"), g("action")).alias("value"))


@query(_values([("css.custom_property.v1", 1), ("css.import.v1", 1), ("css.media_query.v1", 1), ("css.selector_rule.v1", 1), ("xml.config_entry.v1", 1), ("xml.document.v1", 1), ("xml.namespace_declaration.v1", 1)], "pattern_id, n"))
def style_and_xml_facts(s, d):
    f = family(_extracted(s, "facts"), "structural_facts").where("path in ('style.css', 'pom.xml') and pattern_id not like 'manifest%'")
    return f.groupBy("pattern_id").agg(F.count("*").alias("n"))


@query(_values([("be.py", "utf16be", "indexed", 1), ("empty.py", "utf8", "indexed", 0), ("le.py", "utf16le", "indexed", 1), ("odd.py", "odd_utf16", "failed_preserved", None), ("raw.py", "invalid_utf8", "failed_preserved", None), ("u8.py", "utf8", "indexed", 2), ("x.bin", "utf8", "unsupported", None)], "path, decode_status, status, line_count"))
def decode_status(s, d):
    """Encodings by mark and validity; an unreadable file is kept as failed, an unknown one as unsupported."""
    rows = [("u8.py", "é\nx".encode()), ("le.py", b"\xff\xfe" + "x\n".encode("utf-16-le")), ("be.py", b"\xfe\xff" + "x".encode("utf-16-be")), ("odd.py", b"\xff\xfea"), ("raw.py", b"\xff\xff\x00"), ("empty.py", b""), ("x.bin", b"\x01")]
    df = s.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    return snapshots(df).select("path", "decode_status", "status", "line_count")
