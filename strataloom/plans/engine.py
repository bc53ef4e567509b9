"""Queries that run the engine's verbs: scans, updates, deletions and rebinds of an artifact of the test sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.artifact.engine import Engine
from strataloom.artifact.store import foreign_key_check
from strataloom.session import shared_dir, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


def _sources(s: SparkSession, d: str, content: Column | None = None) -> DataFrame:
    """The source texts as raw files, one a path."""
    one = table(s, d, "file_snapshots").groupBy("path").agg(F.max("content").alias("content"), F.max("language").alias("language"))
    return one.select("path", F.encode(F.col("content") if content is None else content, "UTF-8").alias("content"), "language")


def _engine(s: SparkSession) -> Engine:
    return Engine(s, f"{shared_dir(s)}/artifact-{uuid.uuid4().hex}", "/srv/tree")


def _changed(s: SparkSession, d: str) -> DataFrame:
    """The sources some time later: Go files are gone, Python files longer, TOML files no text any more."""
    text = F.when(F.col("language") == "python", F.concat("content", F.lit("\n# end\n"))).otherwise(F.col("content"))
    later = _sources(s, d, text).where("language <> 'go'")
    return later.withColumn("content", F.when(F.col("language") == "toml", F.unhex(F.lit("FFFFFF"))).otherwise(F.col("content")))


_LATEST = "WITH f AS (SELECT path, max(content) AS content, max(language) AS language FROM file_snapshots GROUP BY 1)"
_LINES = "CAST(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN content LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT)"
_ROW = f"'sha256:' || sha256(content) AS content_hash, CAST(strlen(content) AS BIGINT) AS content_bytes, {_LINES} AS line_count"


@query(f"{_LATEST} SELECT path, language, {_ROW}, 'indexed' AS status, CAST(1 AS BIGINT) AS last_revision_id FROM f")
def engine_scan(s, d):
    """A scan of all sources: the files it records."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    return e.store.read("files").select("path", "language", "content_hash", "content_bytes", "line_count", "status", "last_revision_id")


@query(f"""{_LATEST}, n AS (SELECT path, language, CASE WHEN language = 'python' THEN content || chr(10) || '# end' || chr(10) ELSE content END AS content FROM f WHERE language <> 'go')
SELECT path, language, 'sha256:' || CASE WHEN language = 'toml' THEN sha256('\\xFF\\xFF\\xFF'::BLOB) ELSE sha256(content) END AS content_hash, CASE WHEN language = 'toml' THEN 3 ELSE CAST(strlen(content) AS BIGINT) END AS content_bytes,
  CASE WHEN language <> 'toml' THEN {_LINES} END AS line_count, CASE WHEN language = 'toml' THEN 'failed_preserved' ELSE 'indexed' END AS status, CASE WHEN language IN ('python', 'toml') THEN 2 ELSE 1 END AS last_revision_id FROM n""")
def engine_rescan(s, d):
    """Two scans: changed files are replaced, vanished ones gone, unreadable ones preserved, all others as they were."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    e.scan(_changed(s, d), level="symbols")
    return e.store.read("files").select("path", "language", "content_hash", "content_bytes", "line_count", "status", F.col("last_revision_id").cast("int"))


@query(f"""{_LATEST} SELECT CAST(1 AS BIGINT) AS revision_id, path, 'inserted' AS change_kind FROM f
UNION ALL SELECT 2, path, CASE language WHEN 'go' THEN 'deleted' ELSE 'updated' END FROM f WHERE language IN ('go', 'python', 'toml')""")
def engine_journal(s, d):
    """The journal of the two scans; a third one finds nothing to do and writes nothing."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    e.scan(_changed(s, d), level="symbols")
    return e.store.read("revision_file_changes").select("revision_id", "path", "change_kind")


@query("""SELECT language, count(DISTINCT path) AS files FROM symbols WHERE language <> 'go' AND kind IN ('function', 'method', 'class', 'property') GROUP BY 1""")
def engine_symbol_files(s, d):
    """Files with symbols after the two scans, beside the given ones: none of deleted files, still those of unreadable ones."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    e.scan(_changed(s, d), level="symbols")
    kinds = "kind in ('function', 'method', 'class', 'property')"
    given = table(s, d, "symbols").where(kinds).select("path").distinct()
    rows = e.store.read("symbols").where(kinds).join(given, "path", "left_semi")
    return rows.groupBy("language").agg(F.countDistinct("path").alias("files"))


@query("""SELECT fk_name, CAST(0 AS BIGINT) AS dangling FROM (VALUES ('symbols.parent_symbol_id'), ('symbol_annotations.symbol_id'), ('reference_sites.containing_symbol_id'), ('identifiers.containing_symbol_id'), ('relationships.from_symbol_id'),
('relationships.to_symbol_id'), ('pending_relationships.from_symbol_id'), ('pending_relationships.caller_scope_symbol_id'), ('type_facts.symbol_id'), ('type_argument_usages.identifier_id'), ('type_arguments.usage_id'), ('literals.containing_symbol_id'),
('source_regions.containing_symbol_id'), ('structural_facts.containing_symbol_id'), ('complexity_metrics.symbol_id')) v(fk_name)""")
def engine_keys(s, d):
    """Every foreign key of the full artifact after the two scans: nothing dangles."""
    e = _engine(s)
    e.scan(_sources(s, d), level="full")
    e.scan(_changed(s, d), level="full")
    return foreign_key_check(e.store).select("fk_name", "dangling")


@query("""SELECT * FROM (VALUES ('index_level', 'symbols'), ('rebound_from', '/srv/tree'), ('revision', '1'), ('root_path', '/srv/other'), ('schema_version', '8'), ('contract_version', '4'), ('hash_algorithm', 'sha256')) v(key, value)""")
def engine_rebind(s, d):
    """A scanned artifact moved to another root: the metadata that do not hang on time or chance."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    e.rebind("/srv/tree", e.store.manifest()["metadata"]["artifact_id"], "/srv/other")
    fixed = ("index_level", "rebound_from", "revision", "root_path", "schema_version", "contract_version", "hash_algorithm")
    return e.store.read("artifact_metadata").where(F.col("key").isin(*fixed))


@query("""WITH f AS (SELECT path FROM file_snapshots ORDER BY path LIMIT 1)
SELECT 'deleted' AS verb, (SELECT count(DISTINCT path) - 1 FROM file_snapshots) AS files, (SELECT path FROM f) AS path, 'deleted' AS change_kind""")
def engine_delete(s, d):
    """The first file deleted by path: what is left, and its journal entry."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    path = table(s, d, "file_snapshots").agg(F.min("path")).first()[0]
    e.delete(path)
    log = e.store.read("revision_file_changes").where("revision_id = 2").select("path", "change_kind")
    return e.store.read("files").agg(F.lit("deleted").alias("verb"), F.count("*").alias("files")).join(log, F.lit(True))


@query("""SELECT language, true AS target_symbols, actual_symbols, fact_patterns_known FROM (SELECT DISTINCT language, true AS actual_symbols, true AS fact_patterns_known FROM file_snapshots)""")
def engine_capabilities(s, d):
    """The capability tables that a scan mirrors into the artifact, for the languages of the sources."""
    e = _engine(s)
    e.scan(_sources(s, d).limit(1), level="symbols")
    used = table(s, d, "file_snapshots").select("language").distinct()
    rows = e.store.read("language_capabilities").join(used, "language", "left_semi")
    known = F.get_json_object("kind_coverage_json", "$.fact_patterns").cast("int") > 0
    return rows.select("language", "target_symbols", "actual_symbols", known.alias("fact_patterns_known"))


@query("""WITH n AS (SELECT count(DISTINCT path) AS n FROM file_snapshots)
SELECT 'files' AS table_name, n AS rows FROM n UNION ALL SELECT 'revision_file_changes', n FROM n UNION ALL SELECT 'extraction_revisions', 1
UNION ALL SELECT t, 0 FROM (VALUES ('identifiers'), ('relationships'), ('literals'), ('structural_facts'), ('reference_sites')) v(t)""")
def engine_info_totals(s, d):
    """The info verb's totals after a scan at the lowest level: tables whose size the sources tell, the higher families empty."""
    e = _engine(s)
    e.scan(_sources(s, d), level="symbols")
    told = ("files", "revision_file_changes", "extraction_revisions", "identifiers", "relationships", "literals", "structural_facts", "reference_sites")
    return e.info(top=None)["totals"].where(F.col("table_name").isin(*told))


@query("""SELECT f.path, f.language, count(DISTINCT s.symbol_id) AS callables FROM (SELECT path, max(language) AS language FROM file_snapshots GROUP BY 1) f
JOIN (SELECT DISTINCT path, symbol_id FROM symbols WHERE language = 'python' AND kind IN ('class', 'constant')) s USING (path) GROUP BY 1, 2""")
def engine_updates(s, d):
    """Python files written again by updates of a batch: their classes and constants come once, from the newest text."""
    e = _engine(s)
    src = _sources(s, d)
    longer = F.when(F.col("language") == "python", F.concat("content", F.lit("\n# later\n"))).otherwise(F.col("content"))
    e.scan(src, level="symbols")
    e.scan(_sources(s, d, longer), level="symbols")
    e.scan(src, level="symbols")
    rows = e.store.read("symbols").where("language = 'python' and kind in ('class', 'constant')")
    given = table(s, d, "symbols").where("language = 'python' and kind in ('class', 'constant')").select("path").distinct()
    return rows.join(given, "path", "left_semi").groupBy("path", "language").agg(F.count("*").alias("callables"))
