import json

import pytest

from strataloom.artifact.schema import FAMILIES, FOREIGN_KEYS, TABLES
from strataloom.extract import patterns as P
from strataloom.extract.engine import extract, extract_file, family
from strataloom.extract.mask import mask
from strataloom.sources.languages import LANGUAGES

NAMES = {
    "rust": ("a.rs", "pub struct S;\nimpl T for S {\n    fn f(&self) -> i32 { 1 }\n}\n", {"S", "f"}), "go": ("a.go", "package p\n\nfunc F() {}\n\ntype T struct{}\n", {"p", "F", "T"}),
    "java": ("A.java", "package a;\nclass A extends B {\n  int x;\n  A() {}\n  int f(int a) { return g(a); }\n}\n", {"a", "A", "x", "f"}), "python": ("a.py", "X = 1\nclass A(B):\n    def f(self): pass\n", {"X", "A", "f"}),
    "javascript": ("a.js", "export class A { f(x) { return 1 } }\nconst g = (x) => x\n", {"A", "g"}), "typescript": ("a.ts", "interface I {\n  f(x: number): void;\n}\nenum E { A }\n", {"I", "f", "E"}),
    "csharp": ("a.cs", "namespace N {\n  class C : D {\n    public int F(int x) { return x; }\n  }\n}\n", {"N", "C", "F"}), "kotlin": ("a.kt", "class A : B() {\n  fun f(x: Int): Int = x\n}\n", {"A", "f"}), "ruby": ("a.rb", "class A < B\n  def f(x)\n    x\n  end\nend\n", {"A", "f"}),
    "php": ("a.php", "<?php\nnamespace N;\nclass A extends B {\n  public function f($x) { return 1; }\n}\n", {"N", "A", "f"}), "swift": ("a.swift", "struct S: P {\n  func f(x: Int) -> Int { x }\n}\n", {"S", "f"}), "scala": ("a.scala", "object A extends B {\n  def f(x: Int): Int = x\n}\n", {"A", "f"}),
    "c": ("a.c", "#define N 1\nint f(int x) {\n  return x;\n}\nstruct s { int a; };\n", {"N", "f", "s"}), "cpp": ("a.cpp", "namespace n {\nclass C : public D {\n};\n}\n", {"n", "C"}), "lua": ("a.lua", "local function f(x)\n  return x\nend\n", {"f"}), "bash": ("a.sh", "f() {\n  echo 1\n}\n", {"f"}),
    "elixir": ("a.ex", "defmodule A do\n  def f(x) do\n    x\n  end\nend\n", {"A", "f"}), "erlang": ("a.erl", "-module(m).\nf(X) -> X.\n", {"m", "f"}), "zig": ("a.zig", "pub fn f(x: i32) i32 { return x; }\nconst S = struct {};\n", {"f", "S"}), "dart": ("a.dart", "class A extends B {\n  int f(int x) { return x; }\n}\n", {"A", "f"}),
    "r": ("a.R", "f <- function(x) {\n  x\n}\n", {"f"}), "powershell": ("a.ps1", "function Get-X($a) {\n}\n", {"Get-X"}), "gdscript": ("a.gd", "class_name A\nsignal s\nfunc f(x):\n\tpass\n", {"A", "s", "f"}), "vbnet": ("a.vb", "Class A\n  Public Sub F(x As Integer)\n  End Sub\nEnd Class\n", {"A", "F"}),
    "fsharp": ("a.fs", "module M\nlet f x = x\n", {"M", "f"}), "sql": ("a.sql", "CREATE TABLE t (id int);\nCREATE VIEW v AS SELECT * FROM t;\n", {"t", "v"}), "css": ("a.css", ".a { color: red }\n:root { --x: 1 }\n", {".a"}), "toml": ("a.toml", "[t]\nk = 1\n", {"t", "k"}), "yaml": ("a.yml", "k: 1\nl:\n  m: 2\n", {"k", "l", "m"}),
    "json": ("a.json", '{"k": {"l": 1}}', {"k", "l"}), "markdown": ("a.md", "# T\n\n## U\n", {"T", "U"}), "gomod": ("go.mod", "module m\n\nrequire a.b/c v1.0.0\n", {"m"}), "qml": ("a.qml", "Item {\n  property int x: 1\n  signal s\n}\n", {"Item", "x", "s"}), "qmldir": ("qmldir", "module M\nT 1.0 T.qml\n", {"M", "T"}),
}


@pytest.mark.parametrize("language", sorted(NAMES))
def test_symbols(language):
    path, text, names = NAMES[language]
    fam = extract_file(path, language, text)
    assert names <= {s["name"] for s in fam["symbols"]}
    for f in FAMILIES:
        keys = [r[TABLES[f].names[0]] for r in fam[f]]
        assert len(keys) == len(set(keys))
        assert all(set(r) <= set(TABLES[f].names) for r in fam[f])
    for child, col, parent, key, policy in FOREIGN_KEYS:
        known = {r[key] for r in fam[parent]}
        assert all(r.get(col) in known or (policy == "null" and r.get(col) is None) for r in fam[child]), (child, col)


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_hostile_text(language):
    for text in ("", "\0", "{" * 3000, "'" * 999, "/*" * 500, "é\r\n" * 50, "#" * 2000, "<a " * 300, "x(" * 1500):
        m = mask(text, language)
        assert len(m.code) == len(m.bare) == len(text)
        extract_file("f", language, text)


FACTS = {
    "express.route.v1": ("javascript", "app.get('/x/:id', h)"), "flask.route.v1": ("python", "@app.route('/x')\ndef f(): pass\n"), "django.url_pattern.v1": ("python", "path('a/<int:id>/', v)"), "axum.route.v1": ("rust", 'r.route("/x", get(h))'), "gin.route.v1": ("go", 'r.GET("/x", h)'),
    "spring.request_mapping.v1": ("java", '@GetMapping("/x")\nclass A {}'), "aspnet.minimal_api.route.v1": ("csharp", 'app.MapGet("/x", f);'), "laravel.route.v1": ("php", "Route::get('/x', f);"), "rails.resource_route.v1": ("ruby", "  resources :users\n"), "phoenix.route.v1": ("elixir", '  get "/x", C, :index\n'),
    "html.link.v1": ("html", '<a href="/x">t</a>'), "html.form_control.v1": ("html", "<input name='a'>"), "css.media_query.v1": ("css", "@media (min-width: 1px) { a { b: c } }"), "sql.table_definition.v1": ("sql", "CREATE TABLE t (id int);"), "sql.cte.v1": ("sql", "WITH a AS (SELECT 1) SELECT * FROM a"), "sql.join.v1": ("sql", "SELECT * FROM a LEFT JOIN b ON 1=1"),
    "markdown.fenced_code_block.v1": ("markdown", "```py\nx\n```\n"), "markdown.inline_link.v1": ("markdown", "[a](b)"), "toml.array_table.v1": ("toml", "[[a]]\n"), "yaml.anchor.v1": ("yaml", "a: &b 1\n"), "yaml.k8s_resource.v1": ("yaml", "apiVersion: v1\nkind: Pod\n"), "json.ref.v1": ("json", '{"$ref": "#/a"}'),
    "xml.namespace_declaration.v1": ("xml", '<a xmlns:b="u"/>'), "gosum.checksum.v1": ("gosum", "a.b/c v1.0.0 h1:abc=\n"), "go.defer_statement.v1": ("go", "func f() { defer g() }"), "rust.unsafe_block.v1": ("rust", "fn f() { unsafe { g() } }"), "regex.lookaround.v1": ("regex", "a(?=b)"), "bash.shebang.v1": ("bash", "#!/bin/sh\n"),
    "code.marker.v1": ("go", "// TODO(me): x\n"), "vue.sfc_section.v1": ("vue", "<template>\n</template>\n"), "kotlin.suspend_modifier.v1": ("kotlin", "suspend fun f() {}"), "http.client_request.v1": ("javascript", "fetch('/api/x')"), "nextjs.file_route.v1": ("tsx", "x"), "openapi.route.v1": ("yaml", "paths:\n  /x:\n    get:\n"),
}


@pytest.mark.parametrize("pattern", sorted(FACTS))
def test_fact(pattern):
    language, text = FACTS[pattern]
    path = "app/[id]/page.tsx" if pattern.startswith("nextjs") else "f"
    facts = extract_file(path, language, text)["structural_facts"]
    assert pattern in {f["pattern_id"] for f in facts}


def test_facts_ignore_comments_and_strings():
    facts = extract_file("f", "go", '// r.GET("/x", h)\nvar s = "go f("\n')["structural_facts"]
    assert not facts
    assert len({p.id for p in P.PATTERNS}) == len(P.PATTERNS)


def test_calls_access_and_literals():
    src = "def g(a):\n    return a\n\ndef f(x):\n    y = g(x)\n    obj.z = y\n    requests.get('/a/b', x)\n    db.execute('select 1')\n"
    fam = extract_file("a.py", "python", src)
    assert [r["kind"] for r in fam["relationships"]] == ["calls"]
    assert {p["target_display_name"] for p in fam["pending_relationships"]} == {"requests.get", "db.execute"}
    access = {i["name"]: json.loads(i["metadata_json"] or "{}").get("access") for i in fam["identifiers"]}
    assert access["z"] == "write" and access["x"] == "read"
    assert {(l["kind"], l["literal_text"], l["arg_position"]) for l in fam["literals"]} == {("url", "/a/b", 0), ("sql", "select 1", 0)}
    metric = [c for c in fam["complexity_metrics"] if c["scope"] == "symbol"]
    assert len(metric) == 2 and all(c["parameter_count"] == 1 for c in metric)


def test_byte_spans():
    text = "# é\nclass Ä:\n    pass\n"
    s = extract_file("a.py", "python", text)["symbols"][0]
    assert text.encode()[s["start_byte"] : s["end_byte"]].decode().startswith("class Ä") and (s["start_line"], s["start_column"]) == (2, 0)


def test_spark(spark):
    rows = [("1", "a.py", "python", "def f(): pass\n"), ("2", "b", "cobol", "x"), ("3", "c.py", "python", None), (None, "d.py", "python", "x = 1"), ("4", "e.go", "go", "func f( {")]
    df = spark.createDataFrame(rows, "file_id string, path string, language string, text string")
    got = extract(df, "symbols").cache()
    assert sorted(r.file_id for r in got.select("file_id").collect()) == ["1", "2", "3", "4"]
    assert [r.name for r in family(got, "symbols").select("name").collect() if r.name == "f"][:1] == ["f"]
    assert family(got, "identifiers").count() == 0 and family(got, "parse_diagnostics").where("file_id = '4'").count() == 2
    assert extract(df.limit(0)).count() == 0


def test_table_functions(spark):
    from strataloom.functions.tables import register

    names = register(spark)
    assert "extract_symbols" in names and len(names) == len(FAMILIES)
    spark.createDataFrame([("a.py", "python", "def f(): pass\n"), ("b", "python", None)], "path string, language string, text string").createOrReplaceTempView("src")
    rows = spark.sql("SELECT src.path, s.name, s.kind FROM src, LATERAL extract_symbols(src.path, src.language, src.text) s").collect()
    assert [(r.path, r.name, r.kind) for r in rows] == [("a.py", "f", "function")]


VUE = """<template>
  <!-- <script>no()</script> -->
  <a @click="save" :href="link(x)">{{ name }}</a>
</template>
<script lang="ts">
export function save(n: number): number {
  if (n) { return fetch("/api") }
  return n
}
</script>
<style>
.a { color: red; }
</style>
"""


def test_guests_have_rows_in_their_hosts_places():
    fam = extract_file("c.vue", "vue", VUE)
    f = next(s for s in fam["symbols"] if s["name"] == "save")
    data = VUE.encode()
    assert f["language"] == "typescript" and data[f["start_byte"] : f["end_byte"]].decode().startswith("export function save") and f["start_line"] == 6 and f["start_column"] == 0
    assert data[f["body_start_byte"] : f["body_end_byte"]].decode().endswith("return n\n}")
    calls = {(i["name"], i["kind"], i["start_line"]) for i in fam["identifiers"]}
    assert ("save", "call", 3) in calls and ("link", "call", 3) in calls and ("name", "variable_ref", 3) in calls and not any(n == "no" for n, _, _ in calls)
    for i in fam["identifiers"]:
        assert data[i["start_byte"] : i["end_byte"]].decode() == i["name"]
        line = VUE.split("\n")[i["start_line"] - 1].encode()
        assert line[i["start_column"] :].decode().startswith(i["name"])
    handler = next(i for i in fam["identifiers"] if i["name"] == "save" and i["start_line"] == 3)
    assert json.loads(handler["metadata_json"])["target_symbol_id"] == f["symbol_id"]
    assert [(l["kind"], l["literal_text"]) for l in fam["literals"]] == [("url", "/api")]
    files = [c for c in fam["complexity_metrics"] if c["scope"] == "file"]
    assert len(files) == 1 and files[0]["decision_count"] >= 1 and files[0]["end_line"] == 14
    html = extract_file("p.html", "html", "<p>é</p><script>function a() { b() }</script><button onclick='a()'>x</button><script type='text/x'>function c() {}</script>")
    assert [s["name"] for s in html["symbols"] if s["kind"] == "function"] == ["a"]
    a = next(s for s in html["symbols"] if s["name"] == "a")
    assert a["start_column"] == a["start_byte"] == len("<p>é</p><script>".encode())
    assert ("a", "call") in {(i["name"], i["kind"]) for i in html["identifiers"]}


def test_literal_policies():
    from strataloom.extract import policies

    java = 'class A {\n  void f() {\n    stmt.executeQuery("select 1");\n    rest.exchange("http://x", GET);\n    log("no");\n  }\n}\n'
    assert [(l["kind"], l["literal_text"], l["carrier"]) for l in extract_file("A.java", "java", java)["literals"]] == [("sql", "select 1", "stmt.executeQuery"), ("url", "http://x", "rest.exchange")]
    js = '{"name": "a\\"b", "n": 1, "repo": {"url": "http://x"}, "items": [{"k": "v"}, {"k": ""}, {"href": "/h"}], "list": ["s"]}'
    assert [(l["kind"], l["literal_text"], l["carrier"]) for l in extract_file("a.json", "json", js)["literals"]] == [
        ("other", 'a"b', "name"), ("url", "http://x", "repo.url"), ("other", "v", "items[0].k"), ("url", "/h", "items[2].href")
    ]
    toml = 'a = "x"\n[pkg]\nhomepage = "http://h" # c\nd = { v = "1.2", o = [1] }\nl = ["z"]\n'
    assert [(l["kind"], l["literal_text"], l["carrier"]) for l in extract_file("a.toml", "toml", toml)["literals"]] == [("other", "x", "a"), ("url", "http://h", "pkg.homepage"), ("other", "1.2", "pkg.d.v")]
    assert [l["literal_text"] for l in extract_file("a.md", "markdown", "[t](http://x) ![i](i.png)\n")["literals"]] == ["http://x", "i.png"]
    p = policies.policy("get", "query", exclude="request.query")
    assert [policies.classify(p, c) for c in ("a.get", "db.Query", "$request->query", "x.y", None)] == ["url", "sql", None, None, None]


def test_policies_are_a_parameter(tmp_path):
    from strataloom.extract import policies

    (tmp_path / "java.toml").write_text('[literal_carriers]\nurl = ["log"]\n')
    fam = extract_file("A.java", "java", 'class A {\n  void f() {\n    log("u");\n    executeQuery("q");\n  }\n}\n', policies=policies.load(str(tmp_path)))
    assert [(l["kind"], l["literal_text"]) for l in fam["literals"]] == [("url", "u")]


def test_templates_within_templates():
    src = "function f(a) {\n  return `x ${a ? `y ${g({b: '}'})} \\`` : \"`\"} don't {`;\n}\nfunction g() {\n  return `}`;\n}\n"
    fam = extract_file("a.js", "javascript", src)
    assert {s["name"]: src[s["start_byte"] : s["end_byte"]].count("\n") for s in fam["symbols"]} == {"f": 2, "g": 2} and not fam["parse_diagnostics"]


def test_patterns_between_slashes_hide_their_brackets():
    src = "function f(a) {\n  const r = /[({\\/\"']+/g;\n  return a / 2 / b;\n}\nfunction g() {\n  return 1;\n}\n"
    fam = extract_file("a.js", "javascript", src)
    assert {s["name"]: src[s["start_byte"] : s["end_byte"]].count("\n") for s in fam["symbols"]} == {"f": 3, "g": 2} and not fam["parse_diagnostics"]
    rust = "fn f() {\n    let a = '{';\n    let b = r#\"}\"{\"#;\n    let c: &'static str = \"(\";\n}\nfn g() {}\n"
    fam = extract_file("a.rs", "rust", rust)
    assert {s["name"] for s in fam["symbols"] if s["kind"] == "function"} == {"f", "g"} and not fam["parse_diagnostics"]


def test_arguments_arity_and_own_object():
    src = "class A:\n    def run(self):\n        self.go(1, *xs, key=2)\n        self.gone()\n        other.far(a, b)\n\n    def go(self, *a, key=0):\n        pass\n\ndef go():\n    pass\n"
    fam = extract_file("a.py", "python", src)
    ids = {s["symbol_id"]: (s["name"], s["kind"]) for s in fam["symbols"]}
    assert [(ids[r["from_symbol_id"]][0], ids[r["to_symbol_id"]]) for r in fam["relationships"]] == [("run", ("go", "method"))]
    call = next(i for i in fam["identifiers"] if i["name"] == "go" and i["kind"] == "call")
    assert json.loads(call["metadata_json"]) == {"arg_count": 3, "arg_names": ["key"], "arg_spread": True, "receiver": "self"}
    told = {p["target_terminal_name"]: json.loads(p["metadata_json"]) for p in fam["pending_relationships"]}
    assert told == {"gone": {"arity": 0, "receiver_type": "A"}, "far": {"arity": 2}}


def test_half_surrogates_in_literals_are_replaced(spark):
    from strataloom.extract.engine import extract, family

    df = spark.createDataFrame([("f", "a.json", "json", '{"k": "a\\ud800b", "l": "ok"}')], "file_id string, path string, language string, text string")
    assert sorted(r.literal_text for r in family(extract(df), "literals").collect()) == ["a\ufffdb", "ok"]


def test_every_bracket_fault_is_told():
    fam = extract_file("a.go", "go", "package p\nfunc f() {\n\tx := g(1\n}\n}\nfunc h() {\n\ty[0\n")
    assert [(d["kind"], d["message"], d["start_line"]) for d in fam["parse_diagnostics"]] == [
        ("missing", "( is not closed", 3), ("error", "unmatched }", 5), ("missing", "{ is not closed", 6), ("missing", "[ is not closed", 7)
    ]
