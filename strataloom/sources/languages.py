"""Languages: extensions, file names, detection and the marks of comments and strings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import extension, file_name, normalize_path


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    strings: tuple[str, ...] = ('"', "'")
    nested: bool = False
    tier: str = "full"
    doc_line: tuple[str, ...] = ()
    family: str = field(default="braces")


_C = dict(line=("//",), block=(("/*", "*/"),), doc_line=("///", "//!"))
_H = dict(line=("#",), block=())

# The supported languages with their extensions and file names.
LANGUAGES: dict[str, Language] = {
    x.name: x
    for x in (
        Language("rust", ("rs",), nested=True, strings=('"',), **_C),
        Language("c", ("c", "h"), **_C),
        Language("cpp", ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h++"), **_C),
        Language("go", ("go",), strings=('"', "'", "`"), **_C),
        Language("gomod", (), ("go.mod",), line=("//",), tier="pending", family="lines"),
        Language("gosum", (), ("go.sum",), tier="facts", family="lines", strings=()),
        Language("zig", ("zig",), strings=('"',), line=("//",), doc_line=("///", "//!")),
        Language("typescript", ("ts", "mts", "cts"), strings=('"', "'", "`"), **_C),
        Language("tsx", ("tsx",), strings=('"', "'", "`"), **_C),
        Language("javascript", ("js", "mjs", "cjs"), strings=('"', "'", "`"), **_C),
        Language("jsx", ("jsx",), strings=('"', "'", "`"), **_C),
        Language("html", ("html", "htm"), block=(("<!--", "-->"),), family="markup"),
        Language("css", ("css",), block=(("/*", "*/"),), tier="pending"),
        Language("vue", ("vue",), block=(("<!--", "-->"), ("/*", "*/")), line=("//",), strings=('"', "'", "`"), family="markup"),
        Language("python", ("py", "pyi", "pyw"), strings=('"""', "'''", '"', "'"), family="indent", **_H),
        Language("java", ("java",), strings=('"""', '"', "'"), **_C),
        Language("csharp", ("cs",), **_C),
        Language("vbnet", ("vb",), line=("'",), strings=('"',), doc_line=("'''",), family="end"),
        Language("php", ("php", "phtml"), line=("//", "#"), block=(("/*", "*/"),)),
        Language("ruby", ("rb", "rbw", "rake", "gemspec", "ru", "jbuilder", "builder", "thor"), ("Gemfile", "Rakefile"), family="end", line=("#",), block=(("=begin", "=end"),)),
        Language("swift", ("swift",), nested=True, strings=('"""', '"'), **_C),
        Language("kotlin", ("kt", "kts"), nested=True, strings=('"""', '"', "'"), **_C),
        Language("scala", ("scala", "sc", "sbt"), nested=True, strings=('"""', '"'), **_C),
        Language("dart", ("dart",), strings=('"""', "'''", '"', "'"), **_C),
        Language("elixir", ("ex", "exs"), strings=('"""', '"', "'"), family="end", **_H),
        Language("fsharp", ("fs", "fsx", "fsi"), line=("//",), block=(("(*", "*)"),), nested=True, strings=('"""', '"'), doc_line=("///",), family="indent"),
        Language("erlang", ("erl", "hrl", "escript"), ("rebar.config", "sys.config"), line=("%",), family="lines"),
        Language("lua", ("lua",), line=("--",), block=(("--[[", "]]"),), family="end"),
        Language("qml", ("qml", "qmltypes"), strings=('"', "'", "`"), **_C),
        Language("qmldir", (), ("qmldir",), tier="symbols", family="lines", **_H),
        Language("r", ("r",), ("NAMESPACE",), **_H),
        Language("bash", ("sh", "bash", "bats"), (".bashrc", ".bash_profile", ".profile"), **_H),
        Language("powershell", ("ps1", "psm1", "psd1"), line=("#",), block=(("<#", "#>"),)),
        Language("gdscript", ("gd",), strings=('"""', '"', "'"), family="indent", **_H),
        Language("razor", ("razor", "cshtml"), block=(("@*", "*@"), ("<!--", "-->")), line=("//",), family="markup"),
        Language("sql", ("sql",), line=("--",), block=(("/*", "*/"),), strings=("'",), family="sql"),
        Language("regex", ("regex", "regexp"), tier="no_pending", family="lines", strings=()),
        Language("markdown", ("md", "markdown"), block=(("<!--", "-->"),), tier="pending", family="markup", strings=()),
        Language("json", ("json", "jsonl", "jsonc", "ndjson", "jsonld", "geojson", "webmanifest", "code-workspace"), ("Pipfile.lock",), tier="pending", family="data", strings=('"',)),
        Language("toml", ("toml",), ("Pipfile", "Cargo.lock"), tier="pending", family="data", strings=('"""', "'''", '"', "'"), **_H),
        Language("yaml", ("yml", "yaml"), tier="pending", family="data", **_H),
        Language("xml", ("xml", "xsd", "wsdl", "csproj", "props", "targets", "vbproj", "fsproj", "vcxproj", "sqlproj", "proj", "slnx", "nuspec", "resx", "runsettings", "xaml", "axaml", "xsl", "xslt", "xlf", "xliff", "config"), block=(("<!--", "-->"),), tier="pending", family="markup"),
    )
}

#: How C++ gives itself away in a header.
CPP_ONLY = r"(?m)^\s*(class\s+\w+|namespace\b|template\s*<|using\s+\w+|public:|private:|protected:)|::|\bconstexpr\b|\bnullptr\b"


def dimension(spark: SparkSession) -> DataFrame:
    """The languages as a small fixed table (safe to broadcast: one row an extension)."""
    rows = [(l.name, e, l.tier) for l in LANGUAGES.values() for e in l.extensions]
    return spark.createDataFrame(rows, "language string, extension string, tier string")


def detect(path: Column, content: Column | None = None) -> Column:
    """The language of a file by name, extension and, for headers and scripts, content; null when unsupported."""
    name, ext = file_name(path), extension(path)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lang in LANGUAGES.values():
        for f in lang.files:
            out = out.when(name == f, lang.name)
    if content is not None:
        out = out.when((ext == "h") & content.rlike(CPP_ONLY), "cpp")
        shell = r"^#!\s*\S*/(?:env\s+(?:-\S+\s+)*)?(?:bash|sh|bats)\b"
        out = out.when((ext == "") & content.rlike(shell), "bash").when((ext == "") & content.rlike(r"^#!\S*(?:/|env\s+)escript"), "erlang")
    for lang in LANGUAGES.values():
        if lang.extensions:
            out = out.when(ext.isin(*lang.extensions), lang.name)
    return out


def is_json_lines(path: Column) -> Column:
    return extension(normalize_path(path)).isin("jsonl", "ndjson")
