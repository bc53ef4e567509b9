"""The engine's verbs: scan, update, delete, info, languages, rebind, check."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom import __version__
from strataloom.artifact.schema import CONTRACT, FAMILIES, TABLES, VERSION
from strataloom.artifact.store import OWNER, WRITTEN, ArtifactError, Store
from strataloom.extract.declarations import DECLARATIONS
from strataloom.extract.engine import extract, extract_file, family
from strataloom.extract.patterns import PATTERNS
from strataloom.functions.ids import fingerprint, stable_id
from strataloom.operators.ledger import WorkLedger
from strataloom.operators.reports import LEVELS, attribution, revision_diff, table_totals, top_files
from strataloom.session import cut, remove, staged
from strataloom.sources.languages import LANGUAGES
from strataloom.sources.snapshot import SIZE_LIMIT, list_tree, read_listed, read_paths, snapshots, split_known

SOURCE = ("file_id", "path", "content")
_DOMAINS = tuple(f for f in FAMILIES if f != "reference_sites")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def producer() -> str:
    """The generation of the extractors: artifacts of another one are not updated incrementally."""
    import hashlib

    body = json.dumps([__version__, VERSION, CONTRACT, sorted(p.id for p in PATTERNS), sorted(LANGUAGES)])
    return "sha256:" + hashlib.sha256(body.encode()).hexdigest()


class Engine:
    """One artifact of one root."""

    def __init__(self, spark: SparkSession, base: str, root: str = "", progress: Callable[[dict], None] | None = None):
        """``progress`` gets a record at every phase of a verb: discover, extract, commit, done."""
        self.spark, self.store, self.root, self.progress = spark, Store(spark, base), root.rstrip("/"), progress

    # -- writing

    def scan(self, source: DataFrame | None = None, level: str = "full", force: bool = False) -> dict:
        """Brings the artifact to the source's state (the root's tree, or a DataFrame of path and bytes).

        A file whose size and modification time are the recorded ones is not read again. Only files whose content hash
        changed are extracted; vanished files are deleted; unchanged ones stay as they are; files that cannot be read
        keep their old rows; files above ``SIZE_LIMIT`` get a warning instead of rows. Only what changed is written,
        and nothing when nothing changed.
        """
        if level not in LEVELS:
            raise ArtifactError("usage", f"no level {level}")
        version = self.store.version()
        if version:
            meta = self.store.check(self.root, None if force else producer())["metadata"]
            if meta["index_level"] != level and not force:
                raise ArtifactError("level_conflict", f"built at level {meta['index_level']}")
        if source is not None:
            return self._apply(cut(snapshots(source)), level, version, "scan", whole=True, force=force)
        self._tell("discover", "scan")
        listed = cut(list_tree(self.spark, self.root))
        old = self.store.read("files", version) if version and not force else None
        fresh, same = split_known(listed, old)
        if old is not None:
            fresh, same = cut(fresh), cut(same)
            if fresh.isEmpty() and same.count() == old.count():
                return {"status": "no_change", "revision_id": None, "changes": {}}
        raw = read_listed(self.spark, self.root, fresh)
        return self._apply(cut(snapshots(raw)), level, version, "scan", whole=True, force=force, same=same)

    def update(self, path: str, content: bytes | None = None) -> dict:
        """One file brought up to date; status changed, no_change, unsupported or failed."""
        version = self.store.version()
        level = self.store.check(self.root, producer())["metadata"]["index_level"]
        if content is not None:
            raw = self.spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
        else:
            raw = read_paths(self.spark, self.root, [path])
        return self._apply(cut(snapshots(raw)), level, version, "update", whole=False)

    def delete(self, path: str) -> dict:
        """One file removed with all its rows; an unknown path gives not_found and writes nothing."""
        version = self.store.version()
        meta = self.store.check(self.root, producer())["metadata"]
        gone = cut(self.store.read("files", version).where(F.col("path") == path).select("file_id", "path"))
        if gone.isEmpty():
            return {"status": "not_found", "revision_id": None}
        changes = gone.select("file_id", F.lit("deleted").alias("change_kind"), "path")
        return self._commit({}, changes, self._dead(gone, gone, self._revision(version) + 1), version, "delete", meta)

    def _apply(
        self, new: DataFrame, level: str, version: int, operation: str, whole: bool, force: bool = False, same: DataFrame | None = None
    ) -> dict:
        """Brings the files of ``new`` (snapshots) up to date; with ``whole`` all others but ``same`` are deleted."""
        old = self.store.read("files", version) if version else self.spark.createDataFrame([], TABLES["files"])
        base = old if whole else old.join(new.select("file_id"), "file_id", "left_semi")
        if same is not None:
            base = base.join(same.select("file_id"), "file_id", "left_anti")
        base_hash = base.withColumn("content_hash", F.lit("")) if force else base
        diff = revision_diff(base_hash, new, F.col("status") != "unsupported")
        changed = diff.join(base.select("file_id", F.col("content_hash").alias("h"), "status", F.col("path").alias("old_path")), "file_id", "left").join(
            new.select("file_id", F.col("content_hash").alias("n"), F.col("path").alias("new_path")), "file_id", "left"
        )
        # an unsupported file is a change only when it is new or its bytes differ
        still = (F.col("change_kind") == "unsupported") & F.col("status").eqNullSafe(F.lit("unsupported")) & F.col("h").eqNullSafe(F.col("n"))
        diff = cut(changed.where(~still).select("file_id", "change_kind", F.coalesce("new_path", "old_path").alias("path"), F.col("h").isNotNull().alias("known")))
        n = {r["change_kind"]: r["count"] for r in diff.groupBy("change_kind").count().collect()}
        if not n and version:
            return {"status": "no_change", "revision_id": None, "changes": {}}
        revision = self._revision(version) + 1
        touched = diff.select("file_id")
        current = new.join(touched, "file_id", "left_semi")
        # files that cannot be read keep their old rows, if they have any
        kept = cut(current.where("status = 'failed_preserved'").select("file_id").join(old.select("file_id"), "file_id", "left_semi"))
        self._tell("extract", operation, files=sum(n.values()))
        got, place = staged(extract(current.where("status = 'indexed' and not too_large"), level), "extracted")
        fresh = {f: family(got, f, OWNER) for f in FAMILIES}
        fresh["parse_diagnostics"] = fresh["parse_diagnostics"].unionByName(self._warnings(current), allowMissingColumns=True)
        row = current.select(
            "file_id", "path", "language", "content_hash", "content_bytes", "line_count", F.lit(_now()).alias("indexed_at"), F.lit(revision).cast("long").alias("last_revision_id"), "status",
            F.when(F.col("modified").isNotNull(), F.to_json(F.struct("modified"))).alias("metadata_json"),
        )
        tables = fresh | {"files": row.withColumn(OWNER, F.col("file_id"))}
        tables = {f: t.withColumn(WRITTEN, F.lit(revision).cast("long")) for f, t in tables.items()}
        meta = self.store.manifest(version)["metadata"] if version else self._metadata(level)
        if force:
            meta = meta | {"index_level": level, "producer": producer()}
        known = diff.where("known").select("file_id")
        dead = self._dead(known, known.join(kept, "file_id", "left_anti"), revision) if version else None
        if dead is not None:  # of a file that keeps its rows only the diagnostics are replaced
            dead = dead.unionByName(kept.select("file_id", F.lit(revision).cast("long").alias("before"), F.lit("diagnostics").alias("what")))
        out = self._commit(tables, diff.select("file_id", "change_kind", "path"), dead, version, operation, meta, got)
        remove(self.spark, place)
        if operation == "update":
            kind = next(iter(n), None)
            out["status"] = "failed" if not kept.isEmpty() or not current.where("status = 'failed_preserved'").isEmpty() else "unsupported" if kind == "unsupported" else "changed"
        return out | {"changes": n}

    @staticmethod
    def _dead(files: DataFrame, rows: DataFrame, revision: int) -> DataFrame:
        """Whose entries in ``files``, and whose rows in the families, end before a revision."""
        one = lambda t, what: t.select("file_id", F.lit(revision).cast("long").alias("before"), F.lit(what).alias("what"))
        return one(files, "file").unionByName(one(rows, "rows"))

    @staticmethod
    def _warnings(current: DataFrame) -> DataFrame:
        """A diagnostic for each file that is too large to be extracted or cannot be read."""
        zero = [F.lit(0).cast("long").alias(c) for c in ("start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte")]
        failed = F.col("status") == "failed_preserved"
        kind = F.when(failed, "read_failed").otherwise("slow_file_skipped")
        large = F.lit(f"source file exceeds the {SIZE_LIMIT}-byte extraction limit and was skipped")
        return current.where(failed | ((F.col("status") == "indexed") & F.col("too_large"))).select(
            F.col("file_id").alias(OWNER), stable_id("diagnostic", F.col("path"), kind).alias("diagnostic_id"), "file_id", "path", "language", kind.alias("kind"),
            F.when(failed, F.concat(F.lit("content cannot be decoded: "), "decode_status")).otherwise(large).alias("message"), *zero,
        )

    def _tell(self, phase: str, operation: str, **facts: object) -> None:
        """A progress record to whoever listens."""
        if self.progress:
            self.progress({"phase": phase, "operation": operation, "at": _now(), **facts})

    def _revision(self, version: int) -> int:
        return int(self.store.manifest(version)["metadata"].get("revision", 0)) if version else 0

    def _metadata(self, level: str) -> dict:
        return {
            "schema_version": VERSION, "contract_version": CONTRACT, "root_path": self.root, "artifact_id": uuid.uuid4().hex, "index_level": level, "producer": producer(),
            "binary_version": __version__, "created_at": _now(), "hash_algorithm": "sha256", "revision": 0, "size_limit": SIZE_LIMIT,
        }

    def _commit(self, tables: dict, changes: DataFrame, dead: DataFrame | None, version: int, operation: str, meta: dict, got: DataFrame | None = None) -> dict:
        """One revision: the new rows, the journal, and the counts of what was extracted by family."""
        began, started = time.time(), _now()
        self._tell("commit", operation)
        revision = int(meta.get("revision", 0)) + 1
        counts: dict = {}
        if got is not None:
            counts = {f: n or 0 for f, n in got.agg(*[F.sum(F.size(f)).alias(f) for f in FAMILIES]).first().asDict().items()}
        journal = changes.select(F.lit(revision).cast("long").alias("revision_id"), "file_id", "path", "change_kind")
        log = [(revision, revision - 1 or None, operation, meta["index_level"], started, _now(), __version__, CONTRACT, VERSION, self.root, json.dumps(counts, sort_keys=True))]
        meta = meta | {"revision": revision}
        # the capability snapshot is mirrored when the producer is new to the artifact
        mirrored = self._capabilities() if not version or self.store.manifest(version)["metadata"]["producer"] != meta["producer"] else {}
        done = self.store.commit(
            meta, version, add=tables | {"revision_file_changes": journal, "extraction_revisions": self.spark.createDataFrame(log, TABLES["extraction_revisions"])},
            replace=mirrored | {"artifact_metadata": self._metadata_rows(meta)}, dead=dead,
        )
        self._tell("done", operation, revision_id=revision, counts=counts)
        return {"status": "changed", "revision_id": revision, "version": done, "counts": counts, "seconds": round(time.time() - began, 3)}

    def _capabilities(self) -> dict[str, DataFrame]:
        """Parsers, capabilities and gaps of all languages, as tables of the artifact."""
        parsers, able, gaps = [], [], []
        for l in LANGUAGES.values():
            kinds = sorted({k for k, _ in DECLARATIONS.get(l.name, [])} - {"import", "signature"})
            code = l.family not in ("data", "markup", "lines")
            facts = sum(l.name in p.languages for p in PATTERNS)
            parsers.append((l.name, "strataloom.extract", __version__, None, "built-in", json.dumps({"tier": l.tier})))
            has = {"symbols": bool(kinds), "relationships": code, "pending_relationships": code or l.name == "markdown", "identifiers": code, "types": code}
            able.append((l.name, "strataloom.extract", json.dumps(l.extensions), "ok", *[True] * 5, *has.values(), json.dumps({"symbols": kinds, "fact_patterns": facts})))
            gaps += [(f"gap-{l.name}-{c}", l.name, c, "open", "not extracted", "none", "{}") for c, there in has.items() if not there]
        rows = {"parser_inventory": parsers, "language_capabilities": able, "language_capability_gaps": gaps}
        return {t: self.spark.createDataFrame(r, TABLES[t]) for t, r in rows.items()}

    def _metadata_rows(self, meta: dict) -> DataFrame:
        return self.spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], TABLES["artifact_metadata"])

    def consume(self, ledger: WorkLedger, worker: str, work: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Gives every revision of the journal that no worker has processed to ``work``, each exactly once.

        Revisions are the ledger's items; ``work`` gets a revision's changes. Returns the items done here.
        """
        version = self.store.version()
        ledger.add(f"r{i:09d}" for i in range(1, self._revision(version) + 1))
        journal = self.store.read("revision_file_changes", version)
        return ledger.process(worker, lambda item: work(journal.where(F.col("revision_id") == int(item[1:]))))

    # -- reading

    def info(self, top: int | None = 20) -> dict[str, DataFrame]:
        """Metadata, table totals and rows by file (the largest ``top``, or all)."""
        version = self.store.manifest()["version"]
        tables = {t: self.store.read(t, version) for t in TABLES}
        domains = {f: tables[f] for f in _DOMAINS if "file_id" in TABLES[f].names}
        owners = tables["symbols"].select("symbol_id", "file_id")
        for f in ("symbol_annotations", "type_facts"):
            domains[f] = tables[f].join(owners, "symbol_id").select("file_id")
        domains["type_arguments"] = tables["type_arguments"].join(tables["type_argument_usages"].select("usage_id", "file_id"), "usage_id").select("file_id")
        rows = attribution(tables["files"].select("file_id", "path", "language", "status"), domains)
        return {"metadata": tables["artifact_metadata"].orderBy("key"), "totals": table_totals(tables), "files": top_files(rows, top) if top else rows}

    def languages(self) -> DataFrame:
        """The capability snapshot: one row a language with its extensions, tier and number of fact patterns."""
        rows = [(l.name, json.dumps(l.extensions), json.dumps(l.files), l.tier, sum(l.name in p.languages for p in PATTERNS)) for l in LANGUAGES.values()]
        return self.spark.createDataFrame(rows, "language string, extensions_json string, files_json string, tier string, fact_patterns long")

    def rebind(self, expected_root: str, expected_id: str, root: str) -> dict:
        """Moves the artifact to another root: metadata only, and only while it still is what the caller has seen."""
        version = self.store.version()
        m = self.store.check()
        meta = m["metadata"]
        if (meta["root_path"], meta["artifact_id"]) != (expected_root, expected_id):
            raise ArtifactError("identity_changed", "the artifact was replaced meanwhile")
        meta = meta | {"root_path": root.rstrip("/"), "artifact_id": uuid.uuid4().hex, "rebound_from": expected_root, "rebound_at": _now()}
        self.store.commit(meta, version, replace={"artifact_metadata": self._metadata_rows(meta)})
        self.root = meta["root_path"]
        return meta


def check(path: str, text: str, language: str) -> list[dict]:
    """The parse diagnostics of one text."""
    return extract_file(path, language, text, level="symbols")["parse_diagnostics"]


def capability_fingerprint(spark: SparkSession) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [spark.createDataFrame([(l.name, l.tier)], "language string, tier string") for l in LANGUAGES.values()])
    packed = F.to_json(F.array_sort(F.collect_list(F.struct("language", "tier"))))
    return rows.agg(fingerprint(packed).alias("fingerprint"), stable_id("capabilities", packed).alias("snapshot_id"))
