"""The artifact: Parquet tables under one folder, written once and committed by one pointer.

A commit writes only its own rows, as parts ``c=<n>-<id>/<table>``, and a manifest ``manifest/<n>.json`` (created
atomically, never overwritten) that names the parts of every table. Rows of the families and of ``files`` know the
file and revision that wrote them; a file's older rows die by an entry ``(file_id, before, what)`` in the commit's
``dead`` part, so changing one file writes that file's rows alone. Reading leaves the dead out by an anti join that is
only there when something died; ``compact`` folds everything into one part a table. A reader sees whole versions, and
of two writers only one can create the next manifest.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.artifact.schema import CONTRACT, FAMILIES, FOREIGN_KEYS, TABLES, VERSION
from strataloom.operators.integrity import dangling_count, drop_dangling, null_dangling


class ArtifactError(RuntimeError):
    """A refused operation; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


#: Hidden columns of the tables whose rows belong to a file: the file and the revision that wrote the row.
OWNER, WRITTEN = "__file", "__rev"
OWNED = (*FAMILIES, "files")
DEAD = "file_id string, before long, what string"
#: Dead entries that are sent to every reading task; beyond them they meet the rows by a shuffled join.
SENT = 200_000


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 without one."""
        at = self._path(f"{self.base}/manifest")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        v = version or self.version()
        if not v:
            raise ArtifactError("no_artifact", f"no committed artifact in {self.base}")
        reader = self._fs.open(self._path(f"{self.base}/manifest/{v}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
        reader.close()
        return json.loads(text)

    def check(self, root: str | None = None, producer: str | None = None) -> dict:
        """Gates before any use: schema and contract version, root, and (for increments) the producer's fingerprint."""
        m = self.manifest()
        meta = m["metadata"]
        if int(meta["schema_version"]) > VERSION or int(meta["contract_version"]) > CONTRACT:
            raise ArtifactError("artifact_newer", "written by a newer engine")
        if int(meta["schema_version"]) < VERSION or int(meta["contract_version"]) < CONTRACT:
            raise ArtifactError("artifact_older", "older artifacts are readable, never writable")
        if root is not None and meta["root_path"] != root:
            raise ArtifactError("root_mismatch", f"belongs to {meta['root_path']}")
        if producer is not None and meta["producer"] != producer:
            raise ArtifactError("producer_changed", "built by another generation; force a full scan")
        return m

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table's living rows at a version."""
        return self._rows(table, self.manifest(version)).select(*TABLES[table].names)

    def _rows(self, table: str, m: dict) -> DataFrame:
        schema = T.StructType(list(TABLES[table]))
        if table in OWNED:
            schema = schema.add(OWNER, T.StringType()).add(WRITTEN, T.LongType())
        parts = m["parts"].get(table, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.base}/{p}" for p in parts])
        if table in OWNED and m["dead"]:
            what = ["file"] if table == "files" else ["rows", "diagnostics"] if table == "parse_diagnostics" else ["rows"]
            gone = self.spark.read.schema(DEAD).parquet(*[f"{self.base}/{p}" for p in m["dead"]]).where(F.col("what").isin(*what))
            gone = gone.groupBy("file_id").agg(F.max("before").alias("before"))
            gone = F.broadcast(gone) if m["n_dead"] <= SENT else gone.hint("merge")
            rows = rows.join(gone, (rows[OWNER] == gone["file_id"]) & (rows[WRITTEN] < gone["before"]), "left_anti")
        return rows

    def commit(
        self, metadata: dict, expected: int, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None,
        dead: DataFrame | None = None, fold: bool = False,
    ) -> int:
        """Writes rows as parts of a new version and commits it; what is not named is taken over as it is.

        ``add`` appends a part to each table, ``replace`` makes it the table's only part; ``dead`` has the columns of
        ``DEAD``. ``fold``: all earlier parts and dead entries are dropped. ``expected`` is the version the caller has
        read; if another one has been committed since, the commit is refused. Tables are written at the same time.
        """
        if self.version() != expected:
            raise ArtifactError("conflict", f"version {self.version()} was committed meanwhile")
        new = expected + 1
        own = f"c={new}-{uuid.uuid4().hex[:8]}"  # a lost race leaves only an unreferenced folder
        old = self.manifest(expected) if expected and not fold else {"parts": {}, "dead": [], "n_dead": 0}
        parts = {t: list(p) for t, p in old["parts"].items()}

        def write(item: tuple[str, DataFrame]) -> None:
            name, df = item
            fields = list(TABLES[name]) + ([T.StructField(OWNER, T.StringType()), T.StructField(WRITTEN, T.LongType())] if name in OWNED else [])
            cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
            df.select(*cols).write.mode("overwrite").parquet(f"{self.base}/{own}/{name}")

        todo = list((add or {}).items()) + list((replace or {}).items())
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(write, todo))
        for name in add or {}:
            parts.setdefault(name, []).append(f"{own}/{name}")
        for name in replace or {}:
            parts[name] = [f"{own}/{name}"]
        gone, n = list(old["dead"]), old["n_dead"]
        if dead is not None:
            dead.select("file_id", F.col("before").cast("long"), "what").write.mode("overwrite").parquet(f"{self.base}/{own}/dead")
            more = self.spark.read.schema(DEAD).parquet(f"{self.base}/{own}/dead").count()
            if more:
                gone, n = [*gone, f"{own}/dead"], n + more
        body = json.dumps({"version": new, "parts": parts, "dead": gone, "n_dead": n, "metadata": metadata}, sort_keys=True)
        try:
            out = self._fs.create(self._path(f"{self.base}/manifest/{new}.json"), False)
        except Exception as e:
            raise ArtifactError("conflict", f"version {new} was committed meanwhile") from e
        out.write(bytearray(body.encode()))
        out.close()
        return new

    def compact(self) -> int:
        """One part a table, without the dead."""
        version = self.version()
        m = self.manifest(version)
        return self.commit(m["metadata"], version, replace={t: self._rows(t, m) for t in m["parts"]}, fold=True)

    def views(self, prefix: str = "") -> None:
        """All tables as temporary views: any Spark SQL on the artifact."""
        for t in TABLES:
            self.read(t).createOrReplaceTempView(prefix + t)


def enforce(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Foreign keys by policy: required ones drop their row, nullable ones become null."""
    out = dict(tables)
    for child, column, parent, key, policy in FOREIGN_KEYS:
        if child in out and parent in out:
            keys = out[parent].select(F.col(key).alias("__key"))
            out[child] = (drop_dangling if policy == "drop" else null_dangling)(out[child], column, keys, "__key")
    return out


def foreign_key_check(store: Store) -> DataFrame:
    """``fk_name, rows, dangling`` of every key of the committed tables; all dangling counts are 0 in a sound artifact."""
    out = None
    for child, column, parent, key, _ in FOREIGN_KEYS:
        one = dangling_count(store.read(child), column, store.read(parent).select(F.col(key).alias("__k")), "__k", f"{child}.{column}")
        out = one if out is None else out.unionByName(one)
    return out
