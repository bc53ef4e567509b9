"""The general pN_ queries: incremental processing (3), hierarchies (4), drifting schemas (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import drift, hierarchy, ledger
from strataloom.session import cut, table

#: The target schema of raw exports: field and type.
EXPORT_TARGET = {
    "file_id": "string", "path": "string", "language": "string", "content_hash": "string", "content_bytes": "long",
    "line_count": "long", "indexed_at": "string", "last_revision_id": "long", "status": "string",
}
#: Fields approved later.
PROMOTED = {"encoding": "string", "owner_team": "string"}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    states = ledger.item_states(
        table(spark, d, "revision_file_changes"), table(spark, d, "extraction_revisions"), table(spark, d, "consumer_runs"),
        pending_only=True,
    )
    return states.where("state <> 'done'").select("revision_id", "file_id")


def p3_state_counts(spark: SparkSession, d: str) -> DataFrame:
    states = ledger.item_states(
        table(spark, d, "revision_file_changes"), table(spark, d, "extraction_revisions"), table(spark, d, "consumer_runs")
    )
    return states.groupBy("root", "state").agg(F.count("*").alias("items"), F.countDistinct("revision_id").alias("revisions"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Both tables' links in one forest; the first character of an id names its table."""
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    s = table(spark, d, "symbols").select(
        tag("s", "symbol_id").alias("node"), tag("s", "parent_symbol_id").alias("parent"), tag("s", "file_id").alias("loc")
    )
    r = table(spark, d, "extraction_revisions").select(
        tag("r", "revision_id").alias("node"), tag("r", "parent_revision_id").alias("parent"), tag("r", "input_root").alias("loc")
    )
    return s.unionByName(r)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "node_table", F.when(F.substring("node_id", 1, 1) == "s", "symbols").otherwise("extraction_revisions")
    ).withColumn("node_id", F.expr("substring(node_id, 2)"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve(_nodes(spark, d), "node", "parent", "loc", with_path=False)
    return _named(out.where("in_cycle")).select("node_table", "node_id")


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Each node's root, depth, path (as text) and number of descendants."""
    out = hierarchy.resolve(_nodes(spark, d), "node", "parent", "loc", with_counts=True)
    return _named(out).select(
        "node_table", "node_id", F.expr("substring(root_id, 2)").alias("root_id"), "depth",
        F.expr("array_join(transform(path, x -> substring(x, 2)), '/')").alias("path"),
        "n_descendants", "in_cycle", "below_cycle",
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor-descendant pair of both tables, symbols and revisions, with its distance."""
    pairs = hierarchy.closure(hierarchy.resolve(_nodes(spark, d), "node", "parent", "loc"))
    return _named(pairs.withColumnRenamed("descendant_id", "node_id")).select(
        "node_table", F.expr("substring(ancestor_id, 2)").alias("ancestor_id"), F.col("node_id").alias("descendant_id"), "distance"
    )


def _ingested(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    return cut(drift.ingest(table(spark, d, "raw_exports").select(*keep, "payload"), "payload", EXPORT_TARGET, keep))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_ingested(spark, d, ["feed", "batch_no"]), EXPORT_TARGET, "feed", "batch_no", "file_id")


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All exports in one table, with the writing versions beside: values under the names that the reported renames
    lead to are replayed into the approved columns, those of schema and ``PROMOTED``."""
    df = _ingested(spark, d, ["record_id", "feed", "batch_no", "revision_id", "exported_at", "received_at"])
    kinds = EXPORT_TARGET | PROMOTED
    names = drift.lineage(drift.changes(df, EXPORT_TARGET, "feed", "batch_no", "file_id"), list(kinds))
    df = drift.replay(df, {f: (kind, (f, *names[f])) for f, kind in kinds.items()})
    rev = table(spark, d, "extraction_revisions").select(
        "revision_id", "extract_contract_version", "sqlite_schema_version",
        F.regexp_replace(F.trim("binary_version"), r"^v|\+.*$", "").alias("binary_version"),
    ).distinct()
    return df.distinct().join(rev, "revision_id", "left")


QUERIES = {
    "p3_found": p3_found,
    "p3_state_counts": p3_state_counts,
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_descendants": p4_descendants,
    "p5_found": p5_found,
    "p5_table": p5_table,
}

_P3 = r"""
WITH marks AS (SELECT input_root, max(read_until) AS done FROM consumer_runs WHERE outcome = 'ok' GROUP BY 1),
rev AS (
  SELECT DISTINCT r.revision_id, r.input_root,
    CASE WHEN try_cast(r.completed_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' <= m.done THEN 'done' ELSE 'pending' END AS state
  FROM extraction_revisions r LEFT JOIN marks m USING (input_root)
  WHERE try_cast(r.completed_at AS TIMESTAMPTZ) IS NOT NULL),
items AS (
  SELECT DISTINCT c.revision_id, c.file_id, r.input_root, r.state
  FROM revision_file_changes c JOIN rev r USING (revision_id)
  WHERE lower(regexp_replace(c.change_kind, '^\s+|\s+$', '', 'g')) IN ('inserted', 'updated', 'deleted'))
"""
_P4 = """
WITH RECURSIVE n AS (
  SELECT DISTINCT 'symbols' AS t, symbol_id AS id, parent_symbol_id AS p FROM symbols
  UNION ALL
  SELECT DISTINCT 'extraction_revisions', CAST(revision_id AS VARCHAR), CAST(parent_revision_id AS VARCHAR) FROM extraction_revisions),
up AS (
  SELECT t, id, p AS anc, 1 AS dist FROM n WHERE p IN (SELECT id FROM n m WHERE m.t = n.t)
  UNION
  SELECT up.t, up.id, n.p, up.dist + 1 FROM up JOIN n ON up.t = n.t AND up.anc = n.id
  WHERE n.p IN (SELECT id FROM n m WHERE m.t = n.t) AND up.anc <> up.id AND up.dist < 500)
"""
ORACLE = {
    "p3_found": _P3 + "SELECT revision_id, file_id FROM items WHERE state = 'pending'",
    "p3_state_counts": _P3
    + "SELECT input_root AS root, state, count(*) AS items, count(DISTINCT revision_id) AS revisions FROM items GROUP BY 1, 2",
    "p4_found": _P4 + "SELECT DISTINCT t AS node_table, id AS node_id FROM up WHERE anc = id",
    "p4_descendants": """
WITH RECURSIVE n AS (
  SELECT DISTINCT 'symbols' AS t, symbol_id AS id, parent_symbol_id AS p FROM symbols
  UNION ALL
  SELECT DISTINCT 'extraction_revisions', CAST(revision_id AS VARCHAR), CAST(parent_revision_id AS VARCHAR) FROM extraction_revisions),
good AS (
  SELECT t, id, [id] AS path FROM n WHERE p IS NULL OR (t, p) NOT IN (SELECT (t, id) FROM n)
  UNION ALL
  SELECT n.t, n.id, list_append(good.path, n.id) FROM n JOIN good ON n.p = good.id AND n.t = good.t)
SELECT t AS node_table, path[i] AS ancestor_id, id AS descendant_id, CAST(len(path) - i AS BIGINT) AS distance
FROM (SELECT t, id, path, unnest(range(1, len(path))) AS i FROM good)
""",
    "p4_hierarchy": """
WITH RECURSIVE n AS (
  SELECT DISTINCT 'symbols' AS t, symbol_id AS id, parent_symbol_id AS p FROM symbols
  UNION ALL
  SELECT DISTINCT 'extraction_revisions', CAST(revision_id AS VARCHAR), CAST(parent_revision_id AS VARCHAR) FROM extraction_revisions),
good AS (
  SELECT t, id, [id] AS path FROM n WHERE p IS NULL OR (t, p) NOT IN (SELECT (t, id) FROM n)
  UNION ALL
  SELECT n.t, n.id, list_append(good.path, n.id) FROM n JOIN good ON n.p = good.id AND n.t = good.t),
lost AS (SELECT n.t, n.id, n.p FROM n LEFT JOIN good USING (t, id) WHERE good.id IS NULL),
walk AS (
  SELECT t, id, p AS anc, 1 AS k FROM lost
  UNION
  SELECT walk.t, walk.id, lost.p, k + 1 FROM walk JOIN lost ON walk.t = lost.t AND walk.anc = lost.id WHERE walk.anc <> walk.id AND k < 500),
cyc AS (SELECT DISTINCT t, id FROM walk WHERE anc = id),
below AS (SELECT t, a AS id, count(*) AS k FROM (SELECT t, id, unnest(path[:-2]) AS a FROM good) GROUP BY 1, 2)
SELECT n.t AS node_table, n.id AS node_id, good.path[1] AS root_id, CAST(len(good.path) - 1 AS BIGINT) AS depth,
  array_to_string(good.path, '/') AS path,
  CASE WHEN good.id IS NOT NULL THEN coalesce(below.k, 0) END AS n_descendants,
  cyc.id IS NOT NULL AS in_cycle, good.id IS NULL AND cyc.id IS NULL AS below_cycle
FROM n LEFT JOIN good USING (t, id) LEFT JOIN cyc USING (t, id) LEFT JOIN below USING (t, id)
""",
    "p5_found": """
WITH leaf AS (
  SELECT feed, batch_no, json_extract_string(payload, '$.file_id') AS f,
    replace(replace(substr(j.fullkey, 3), '".', '.'), '"', '') AS k,
    CASE WHEN j.type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN j.type = 'DOUBLE' THEN 'decimal' WHEN j.type = 'VARCHAR' THEN 'string'
      WHEN j.type = 'NULL' THEN NULL ELSE lower(j.type) END AS ty,
    CASE WHEN j.type <> 'NULL' THEN CAST(j.value AS VARCHAR) END AS v
  FROM (SELECT DISTINCT feed, batch_no, payload FROM raw_exports), json_tree(payload) j
  WHERE j.type <> 'OBJECT' AND NOT contains(j.fullkey, '[')),
pres AS (SELECT feed, batch_no, k, max(ty) AS ty FROM leaf GROUP BY 1, 2, 3),
bat AS (SELECT DISTINCT feed, batch_no FROM raw_exports),
nxt AS (SELECT a.feed, a.batch_no FROM bat a JOIN bat b ON a.feed = b.feed AND a.batch_no = b.batch_no + 1),
added AS (SELECT p.* FROM pres p JOIN nxt USING (feed, batch_no) WHERE NOT EXISTS (SELECT 1 FROM pres q WHERE q.feed = p.feed AND q.batch_no = p.batch_no - 1 AND q.k = p.k)),
gone AS (SELECT n.feed, n.batch_no, p.k FROM pres p JOIN nxt n ON p.feed = n.feed AND p.batch_no = n.batch_no - 1
  WHERE NOT EXISTS (SELECT 1 FROM pres q WHERE q.feed = n.feed AND q.batch_no = n.batch_no AND q.k = p.k)),
ren AS (
  SELECT g.feed, g.batch_no, g.k AS o, a.k AS n FROM gone g JOIN added a USING (feed, batch_no)
  JOIN leaf x ON x.feed = g.feed AND x.batch_no = g.batch_no - 1 AND x.k = g.k AND x.v IS NOT NULL
  JOIN leaf y ON y.feed = g.feed AND y.batch_no = g.batch_no AND y.k = a.k AND y.v IS NOT NULL AND y.f = x.f
  GROUP BY 1, 2, 3, 4 HAVING bool_and(x.v = y.v))
SELECT feed, batch_no, 'renamed' AS change_type, o AS old_field, n AS new_field FROM ren
UNION ALL SELECT feed, batch_no, 'added', '', k FROM added WHERE (feed, batch_no, k) NOT IN (SELECT (feed, batch_no, n) FROM ren)
UNION ALL SELECT feed, batch_no, 'removed', k, '' FROM gone WHERE (feed, batch_no, k) NOT IN (SELECT (feed, batch_no, o) FROM ren)
UNION ALL SELECT n.feed, n.batch_no, 'retyped', p.k, p.k FROM nxt n JOIN pres p USING (feed, batch_no)
  JOIN pres q ON q.feed = n.feed AND q.batch_no = n.batch_no - 1 AND q.k = p.k WHERE p.ty <> q.ty
""",
}
