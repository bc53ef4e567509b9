"""Queries that run the extractors over the source texts of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.artifact.schema import FAMILIES
from strataloom.extract.comments import marks
from strataloom.extract.engine import counts, extract, family
from strataloom.extract.patterns import PATTERNS
from strataloom.operators import integrity
from strataloom.operators.reports import LEVELS, level_families
from strataloom.plans.catalog import _CLEAN, _EXT, _NAMES
from strataloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "file_snapshots").select("file_id", "path", "language", F.col("content").alias("text")).distinct()


def _family_query(name: str):
    level = next(l for l in LEVELS if name in level_families(l))

    def run(s: SparkSession, d: str) -> DataFrame:
        return family(extract(_files(s, d), level), name)

    run.__name__ = f"extract_{name}"
    run.__doc__ = f"The {name} of every source file."
    return run


for _f in FAMILIES:
    QUERIES[f"extract_{_f}"] = _family_query(_f)


def extract_table_counts(s: SparkSession, d: str) -> DataFrame:
    """Rows of each family by language, with all foreign keys enforced."""
    return counts(_files(s, d), "full")


def extracted_levels(s: SparkSession, d: str) -> DataFrame:
    """Rows at every level, over all files: the level reaches the extractor, nothing is computed to be dropped."""
    files = _files(s, d)
    out = None
    for level in LEVELS:
        got = extract(files, level)
        one = got.agg(
            F.lit(level).alias("level"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size("structural_facts")).alias("facts"),
            F.sum(F.size("relationships") + F.size("pending_relationships")).alias("relationships"), F.sum(F.size("identifiers")).alias("identifiers"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def token_hashes_all(s: SparkSession, d: str) -> DataFrame:
    """The hash of normalised tokens of every file version, in all languages."""
    return marks(table(s, d, "file_snapshots").select("file_id", "language", F.col("content").alias("text"))).select("file_id", "token_hash").distinct()


def comment_markers_all(s: SparkSession, d: str) -> DataFrame:
    """Markers in the comments of every file version, in all languages; repeated snapshot rows count once, equal lines each."""
    once = marks(table(s, d, "file_snapshots").select("file_id", "language", F.col("content").alias("text"))).where(F.size("markers") > 0).distinct()
    return once.select("file_id", F.explode("markers").alias("marker")).groupBy("file_id", "marker").agg(F.count("*").alias("n"))


def identifier_access(s: SparkSession, d: str) -> DataFrame:
    """How names are read and written in all files, by language."""
    i = family(extract(_files(s, d), "full"), "identifiers").select("language", "kind", F.get_json_object("metadata_json", "$.access").alias("access"))
    return i.where("access is not null").groupBy("language", "kind", "access").agg(F.count("*").alias("n"))


def syntax_check_files(s: SparkSession, d: str) -> DataFrame:
    """The diagnostics of all files."""
    return family(extract(_files(s, d), "symbols"), "parse_diagnostics").select("file_id", "path", "kind", "start_byte")


def extracted_against_given(s: SparkSession, d: str) -> DataFrame:
    """Extracted names beside the given symbols: agreement by language and kind group."""
    group = F.when(F.col("kind").isin("function", "method", "constructor"), "callable").when(F.col("kind").isin("class", "struct", "interface", "trait", "enum"), "type").otherwise("other")
    mine = family(extract(_files(s, d), "symbols"), "symbols").select("file_id", "language", "name", "start_byte", group.alias("grp")).distinct().withColumn("mine", F.lit(1))
    given = table(s, d, "symbols").select("file_id", "language", "name", "start_byte", group.alias("grp")).distinct().withColumn("given", F.lit(1))
    both = mine.join(given, ["file_id", "language", "name", "start_byte", "grp"], "full")
    return both.groupBy("language", "grp").agg(F.count("mine").alias("extracted"), F.count("given").alias("given"), F.count_if(F.col("mine").isNotNull() & F.col("given").isNotNull()).alias("agreed"))


def toml_tables(s: SparkSession, d: str) -> DataFrame:
    facts = family(extract(_files(s, d).where("language = 'toml'"), "facts"), "structural_facts")
    named = facts.where(F.col("pattern_id").isin("toml.table.v1", "toml.array_table.v1"))
    return named.groupBy("file_id", "pattern_id").agg(F.count("*").alias("n"), F.max(F.get_json_object("metadata_json", "$.name")).alias("last_name"))


ORACLE["toml_tables"] = r"""
WITH l AS (SELECT DISTINCT file_id, content FROM file_snapshots WHERE language = 'toml'), x AS (SELECT file_id, unnest(string_split(content, chr(10))) AS t FROM l),
h AS (SELECT file_id, CASE WHEN regexp_matches(t, '^[ \t]*\[\[') THEN 'toml.array_table.v1' ELSE 'toml.table.v1' END AS pattern_id, trim(regexp_extract(t, '^[ \t]*\[{1,2}[ \t]*([^\]\n]+?)[ \t]*\]', 1)) AS name
  FROM x WHERE regexp_matches(t, '^[ \t]*(\[\[[ \t]*[^\]\n]+\]\]|\[[^\[\]\n]+\])'))
SELECT file_id, pattern_id, count(*) AS n, max(name) AS last_name FROM h GROUP BY 1, 2"""


def json_property_facts(s: SparkSession, d: str) -> DataFrame:
    facts = family(extract(_files(s, d).where("language = 'json'"), "facts"), "structural_facts")
    return facts.where("pattern_id = 'json.property.v1'").groupBy("file_id").agg(F.count("*").alias("properties"), F.countDistinct(F.get_json_object("metadata_json", "$.key")).alias("names"))


ORACLE["json_property_facts"] = r"""
WITH l AS (SELECT DISTINCT file_id, content FROM file_snapshots WHERE language = 'json'),
k AS (SELECT file_id, unnest(regexp_extract_all(content, '"((?:[^"\\\n]|\\.)*)"\s*:', 1)) AS k FROM l)
SELECT file_id, count(*) AS properties, count(DISTINCT k) AS names FROM k GROUP BY 1"""


def json_literals(s: SparkSession, d: str) -> DataFrame:
    """The string values of configuration keys in JSON files that parse, with the path of keys that carries them."""
    got = extract(_files(s, d).where("language = 'json'"), "full")
    whole = got.where(F.size("parse_diagnostics") == 0)
    return family(whole, "literals").select("file_id", "carrier", "literal_text", "kind")


_URL_KEYS = "url uri href homepage repository documentation website endpoint base_url base-url baseurl api_url api-url apiurl".split()
ORACLE["json_literals"] = f"""
WITH l AS (SELECT DISTINCT file_id, content FROM file_snapshots WHERE language = 'json' AND json_valid(content)),
v AS (SELECT l.file_id, j.fullkey, j.key, j.type, j.atom->>'$' AS atom FROM l, json_tree(l.content) j)
SELECT file_id, replace(substr(fullkey, 3), '"', '') AS carrier, atom AS literal_text,
  CASE WHEN lower(key) IN ({", ".join(repr(k) for k in _URL_KEYS)}) THEN 'url' ELSE 'other' END AS kind
FROM v WHERE type = 'VARCHAR' AND NOT ends_with(fullkey, ']') AND atom <> ''"""


def go_functions(s: SparkSession, d: str) -> DataFrame:
    sym = family(extract(_files(s, d).where("language = 'go'"), "symbols"), "symbols")
    return sym.where("kind in ('function', 'method') and signature like 'func%'").groupBy("file_id").agg(F.count("*").alias("functions"))


ORACLE["go_functions"] = r"""
WITH l AS (SELECT DISTINCT file_id, content FROM file_snapshots WHERE language = 'go')
SELECT file_id, len(regexp_extract_all(content, '(?m)^func\s+(\([^)]*\)\s*)?[\p{L}_]\w*\s*\(', 0)) AS functions FROM l WHERE len(regexp_extract_all(content, '(?m)^func\s+(\([^)]*\)\s*)?[\p{L}_]\w*\s*\(', 0)) > 0"""


def extracted_callables(s: SparkSession, d: str) -> DataFrame:
    """The given functions and methods that the extractor finds, at their place and under their name: all of them."""
    kinds = "kind in ('function', 'method')"
    mine = family(extract(_files(s, d), "symbols"), "symbols").where(kinds).select("file_id", "name", "start_byte").distinct()
    return table(s, d, "symbols").where(kinds).select("file_id", "name", "start_byte").distinct().join(mine, ["file_id", "name", "start_byte"])


ORACLE["extracted_callables"] = "SELECT DISTINCT file_id, name, start_byte FROM symbols WHERE kind IN ('function', 'method')"


def extracted_constants(s: SparkSession, d: str) -> DataFrame:
    """The given constants and properties (JSON's of files that parse) that the extractor finds with the same span: all of them."""
    broken = table(s, d, "file_snapshots").where("language = 'json' and try_parse_json(content) is null").select("file_id")
    mine = family(extract(_files(s, d), "symbols"), "symbols").select("file_id", "kind", "start_byte", "end_byte").distinct()
    return table(s, d, "symbols").where("kind in ('constant', 'property')").select("file_id", "kind", "start_byte", "end_byte").distinct().join(broken, "file_id", "left_anti").join(mine, ["file_id", "kind", "start_byte", "end_byte"])


ORACLE["extracted_constants"] = "SELECT DISTINCT file_id, kind, start_byte, end_byte FROM symbols WHERE kind IN ('constant', 'property') AND file_id NOT IN (SELECT file_id FROM file_snapshots WHERE language = 'json' AND NOT json_valid(content))"


def file_metrics(s: SparkSession, d: str) -> DataFrame:
    """The extent that each file's complexity covers."""
    m = family(extract(_files(s, d), "full"), "complexity_metrics")
    return m.where("scope = 'file'").select("file_id", "covered_bytes", "start_byte", "end_byte", "start_line")


ORACLE["file_metrics"] = "SELECT DISTINCT file_id, CAST(strlen(content) AS BIGINT) AS covered_bytes, CAST(0 AS BIGINT) AS start_byte, CAST(strlen(content) AS BIGINT) AS end_byte, CAST(1 AS BIGINT) AS start_line FROM file_snapshots"


def level_strip(s: SparkSession, d: str) -> DataFrame:
    """Which row families have rows at each detail level, over all files; symbols are the given callables that are found."""
    kinds = "kind in ('function', 'method')"
    given = table(s, d, "symbols").where(kinds).select("file_id", "name", "start_byte").distinct()
    out = None
    for level in LEVELS:
        got = extract(_files(s, d), level)
        mine = family(got, "symbols").where(kinds).select("file_id", "name", "start_byte").distinct()
        found = given.join(mine, ["file_id", "name", "start_byte"]).agg(F.lit(level).alias("level"), F.count("*").alias("callables"))
        some = got.agg(F.lit(level).alias("level"), *[(F.sum(F.size(f)) > 0).alias(f) for f in ("structural_facts", "complexity_metrics", "identifiers", "source_regions")])
        one = found.join(some, "level")
        out = one if out is None else out.unionByName(one)
    return out


_GIVEN = "(SELECT count(*) FROM (SELECT DISTINCT file_id, name, start_byte FROM symbols WHERE kind IN ('function', 'method')))"
ORACLE["level_strip"] = "\nUNION ALL ".join(
    f"SELECT '{l}' AS level, {_GIVEN} AS callables, " + ", ".join(f"{str(f in level_families(l)).lower()} AS {f}" for f in ("structural_facts", "complexity_metrics", "identifiers", "source_regions"))
    for l in LEVELS
)


def json_diagnostics(s: SparkSession, d: str) -> DataFrame:
    """JSON files with a parse diagnostic."""
    got = family(extract(_files(s, d).where("language = 'json'"), "symbols"), "parse_diagnostics")
    return got.select("file_id", "kind").distinct()


ORACLE["json_diagnostics"] = "SELECT DISTINCT file_id, 'error' AS kind FROM file_snapshots WHERE language = 'json' AND NOT json_valid(content)"


def json_string_regions(s: SparkSession, d: str) -> DataFrame:
    """String regions of the JSON files that parse: their number and bytes."""
    got = extract(_files(s, d).where("language = 'json'"), "full").where(F.size("parse_diagnostics") == 0)
    r = family(got, "source_regions").where("kind = 'string_literal'")
    return r.groupBy("file_id").agg(F.count("*").alias("regions"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"))


ORACLE["json_string_regions"] = r"""
WITH l AS (SELECT DISTINCT file_id, content FROM file_snapshots WHERE language = 'json' AND json_valid(content)), x AS (SELECT file_id, unnest(regexp_extract_all(content, '"(?:[^"\\]|\\.)*"', 0)) AS t FROM l)
SELECT file_id, count(*) AS regions, CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM x GROUP BY 1"""


def pattern_registry(s: SparkSession, d: str) -> DataFrame:
    """The registered fact patterns, sorted by id."""
    rows = [(p.id, ",".join(p.languages), p.family, p.node) for p in PATTERNS] + [("code.marker.v1", "*", "marker", "comment"), ("nextjs.file_route.v1", "javascript,jsx,typescript,tsx", "framework", "program"), ("nuxt.file_route.v1", "vue,javascript,jsx,typescript,tsx", "framework", "program")]
    return s.createDataFrame(rows, "pattern_id string, languages string, query_family string, node_kind string").orderBy("pattern_id")


def unchanged_files(s: SparkSession, d: str) -> DataFrame:
    """Files whose language by name agrees with the recorded one (left-semi on path and language)."""
    from strataloom.functions.text import normalize_path
    from strataloom.sources.languages import detect

    f = table(s, d, "files").select("file_id", "path", "language")
    mine = f.select(normalize_path(F.col("path")).alias("p"), detect(F.col("path")).alias("l"))
    return f.join(mine, (f["path"] == mine["p"]) & (f["language"] == mine["l"]), "left_semi").select("file_id", "path")


ORACLE["unchanged_files"] = f"WITH n AS (SELECT *, list_last(string_split({_CLEAN}, '/')) AS name FROM files) SELECT file_id, path FROM n WHERE language = CASE {_NAMES} {_EXT} END AND path = {_CLEAN}"


def dangling_parents(s: SparkSession, d: str) -> DataFrame:
    """Given symbols whose parent is missing, with the parent nulled."""
    sym = table(s, d, "symbols").select("symbol_id", "parent_symbol_id").distinct()
    keys = sym.select(F.col("symbol_id").alias("k"))
    nulled = integrity.null_dangling(sym, "parent_symbol_id", keys, "k").withColumnRenamed("parent_symbol_id", "now")
    return sym.where("parent_symbol_id is not null").join(nulled, "symbol_id").where("now is null").select("symbol_id", "parent_symbol_id")


ORACLE["dangling_parents"] = "SELECT DISTINCT symbol_id, parent_symbol_id FROM symbols WHERE parent_symbol_id IS NOT NULL AND parent_symbol_id NOT IN (SELECT symbol_id FROM symbols)"

for _q in (extract_table_counts, extracted_levels, token_hashes_all, comment_markers_all, identifier_access, syntax_check_files, extracted_against_given, toml_tables, json_property_facts, json_literals, extracted_callables, extracted_constants, file_metrics, level_strip, json_diagnostics, json_string_regions, go_functions, pattern_registry, unchanged_files, dangling_parents):
    QUERIES[_q.__name__] = _q
