"""Processing only new or changed records: a work-item ledger with leases and fencing tokens.

Two faces of one ledger. ``entries`` folds an attempt history into leases and commits by fencing token, ``claimed``
and ``item_states`` give every work item the entry that holds it (pending, leased, done), as DataFrames.
``WorkLedger`` keeps such a ledger in a shared folder for this engine's own runs: leases are files created
atomically, expired leases return to pending, a higher fencing token rejects a stale writer, and each item's output
path depends on the item alone, so a retry finds what an earlier attempt has published.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataloom.session import utc_micros

#: Change kinds that ask for work.
WORK_KINDS = ("inserted", "updated", "deleted")


def clean_kind(col: str):
    """A change kind without stray white space, in lower case."""
    return F.lower(F.regexp_replace(col, r"^[\s ﻿]+|[\s ﻿]+$", ""))


def entries(attempts: DataFrame, now_us: int | None = None, ttl_us: int = 3_600_000_000) -> DataFrame:
    """The ledger of an attempt history, one row a usable attempt: ``root, token, low_us, high_us, state``.

    An attempt leases its root's backlog up to ``read_until``; its fencing token is ``(run_id, attempt)``. The first
    commit of an item counts: an ``ok`` attempt is ``done`` for the items in (low_us, high_us], those that no attempt
    of a lower token has committed; where nothing is left for it, it is a ``stale`` writer and commits nothing. A
    running attempt is ``leased`` until ``ttl_us`` after its start or until a later token of its root began, then
    ``expired``; any other outcome is ``released``. Items of a released or expired lease are pending again.
    ``now_us`` None is the last instant the history knows. Attempts without root or ``read_until`` are no entries;
    repeated rows are one.
    """
    rows = attempts.where("input_root is not null").select(
        F.col("input_root").alias("root"), F.struct("run_id", "attempt").alias("token"), "outcome",
        utc_micros(attempts, "read_until").alias("high_us"), utc_micros(attempts, "started_at").alias("began"),
        utc_micros(attempts, "finished_at").alias("ended"),
    ).where("high_us is not null").distinct()
    if now_us is None:
        last = rows.agg(F.max(F.greatest("began", "ended"))).first()[0]
        now_us = last if last is not None else 0
    order = W.partitionBy("root").orderBy("token")
    ok = F.col("outcome") == "ok"
    rows = rows.withColumn("low_us", F.max(F.when(ok, F.col("high_us"))).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("next", F.lead("token").over(order))
    live = (F.col("began") + ttl_us > now_us) & (F.col("began") <= now_us) & F.col("next").isNull()
    state = (
        F.when(ok & (F.col("low_us").isNull() | (F.col("high_us") > F.col("low_us"))), "done")
        .when(ok, "stale")
        .when((F.col("outcome") == "running") & live, "leased")
        .when(F.col("outcome") == "running", "expired")
        .otherwise("released")
    )
    return rows.select("root", "token", "low_us", "high_us", state.alias("state"))


def claimed(items: DataFrame, ledger: DataFrame, salts: int = 16) -> DataFrame:
    """Adds ``state`` and ``token`` to ``items(root, completed_us, ...)`` by the entry that holds them.

    Done ranges of one root follow each other, so the entry of an item is the nearest one at or above its completion:
    one as-of pass, entries and items sorted together. Items are salted and the entries (a log of runs, small beside
    the items) repeated for each salt, so a root with a third of all items is not one task.
    """
    cols = [c for c in items.columns if c not in ("root", "completed_us")]
    held = ledger.where("state in ('done', 'leased')").select(
        "root", F.col("high_us").alias("us"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("o"),
        F.when(F.col("state") == "done", F.col("token")).alias("by"), F.when(F.col("state") == "leased", F.col("token")).alias("lease"),
        F.lit(None).cast(items.select(F.struct(*cols)).schema[0].dataType).alias("item"),
    )
    void = F.lit(None).cast(ledger.schema["token"].dataType)
    mine = items.select(
        "root", F.col("completed_us").alias("us"), F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("o"),
        void.alias("by"), void.alias("lease"), F.struct(*cols).alias("item"),
    )
    down = W.partitionBy("root", "salt").orderBy(F.desc("us"), "o").rowsBetween(W.unboundedPreceding, 0)
    both = held.unionByName(mine).select(
        "root", "us", "o", "item", F.last("by", ignorenulls=True).over(down).alias("by"), F.max("lease").over(down).alias("lease")
    )
    state = F.when(F.col("by").isNotNull(), "done").when(F.col("lease").isNotNull(), "leased").otherwise("pending")
    return both.where("o = 1").select("root", F.col("us").alias("completed_us"), "item.*", state.alias("state"), F.coalesce("by", "lease").alias("token"))


def item_states(
    changes: DataFrame, revisions: DataFrame, attempts: DataFrame, now_us: int | None = None, pending_only: bool = False
) -> DataFrame:
    """The state of each work item ``(revision_id, file_id)``: pending, leased or done.

    Columns: ``root, revision_id, file_id, path, change_kind, completed_us, state, token`` (the fencing token that
    committed or holds it; null while pending). An item exists where its revision has a readable ``completed_at`` and
    the cleaned change kind is one of ``WORK_KINDS``; repeated rows make one item; revisions without root, ids that
    are null and changes without revision make none. States come from the ledger's entries (``entries``, at
    ``now_us``). ``pending_only`` leaves out done items before the large join.
    """
    rev = revisions.select(
        "revision_id", F.col("input_root").alias("root"), utc_micros(revisions, "completed_at").alias("completed_us")
    ).where("completed_us is not null and revision_id is not null and root is not null")
    rev = claimed(rev, entries(attempts, now_us))
    if pending_only:
        rev = rev.where("state <> 'done'")
    # repeated rows of a revision; of several completions the one furthest behind counts
    rev = rev.groupBy("revision_id").agg(F.max(F.struct("state", "root", "completed_us", "token")).alias("r")).select("revision_id", "r.*")
    work = (
        changes.select("revision_id", "file_id", "path", clean_kind("change_kind").alias("change_kind"))
        .where(F.col("change_kind").isin(*WORK_KINDS) & F.col("revision_id").isNotNull() & F.col("file_id").isNotNull())
        .join(rev, "revision_id")
    )
    return work.groupBy("revision_id", "file_id").agg(
        F.min("root").alias("root"), F.min("path").alias("path"), F.min("change_kind").alias("change_kind"),
        F.min("completed_us").alias("completed_us"), F.min("state").alias("state"), F.min("token").alias("token"),
    )


class StaleWriter(RuntimeError):
    """A writer whose fencing token is no longer the highest of its item."""


@dataclass
class Lease:
    item: str
    token: int
    worker: str
    expires: float


class WorkLedger:
    """A ledger of work items in a shared folder (any Hadoop file system).

    Layout: ``items/<item>`` (pending), ``leases/<item>/<token>`` (one file a lease, created atomically without
    overwriting: of two workers one gets the token), ``work/<item>/<token>`` (what an attempt is writing),
    ``out/<item>`` (the item's output: published whole by a rename that fails where another attempt was first) and
    ``done/<item>`` (the commit, created atomically). The ledger holds work items (root and revision range), never
    records. Work must be a function of the item, so whichever attempt publishes, the rows are the same.
    """

    def __init__(self, spark: SparkSession, base: str, ttl: float = 3600.0, clock: Callable[[], float] = time.time):
        self.spark, self.base, self.ttl, self.clock = spark, base.rstrip("/"), ttl, clock
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in ("items", "leases", "work", "out", "done"):
            self._fs.mkdirs(self._path(f"{self.base}/{d}"))

    def _create(self, at: str, body: dict) -> bool:
        try:
            out = self._fs.create(self._path(at), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return True

    def _read(self, at: str) -> dict | None:
        p = self._path(at)
        if not self._fs.exists(p):
            return None
        reader = self._fs.open(p)
        raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
        reader.close()
        return json.loads(raw or "{}")

    def _names(self, at: str) -> list[str]:
        p = self._path(at)
        if not self._fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p) if not s.getPath().getName().endswith(".crc"))

    def add(self, items: Iterable[str]) -> int:
        """Registers work items; known ones stay as they are. Returns how many are new."""
        return sum(self._create(f"{self.base}/items/{i}", {}) for i in items)

    def state(self, item: str) -> str:
        if self._fs.exists(self._path(f"{self.base}/done/{item}")):
            return "done"
        last = self._last(item)
        return "leased" if last and last.expires > self.clock() else "pending"

    def _last(self, item: str) -> Lease | None:
        tokens = [int(x) for x in self._names(f"{self.base}/leases/{item}")]
        if not tokens:
            return None
        body = self._read(f"{self.base}/leases/{item}/{max(tokens)}") or {}
        return Lease(item, max(tokens), body.get("worker", ""), body.get("expires", 0.0))

    def states(self) -> dict[str, str]:
        return {i: self.state(i) for i in self._names(f"{self.base}/items")}

    def lease(self, worker: str, item: str) -> Lease | None:
        """Takes the item's next token, if it is pending (or its lease has expired); None where another was faster."""
        if self.state(item) != "pending":
            return None
        last = self._last(item)
        got = Lease(item, last.token + 1 if last else 1, worker, self.clock() + self.ttl)
        made = self._create(f"{self.base}/leases/{item}/{got.token}", {"worker": worker, "expires": got.expires})
        return got if made else None

    def staging(self, lease: Lease) -> str:
        """Where this attempt writes; nobody reads it."""
        return f"{self.base}/work/{lease.item}/{lease.token}"

    def output(self, item: str) -> str:
        """Where the item's rows are found, whichever attempt wrote them."""
        return f"{self.base}/out/{item}"

    def commit(self, lease: Lease) -> None:
        """Publishes this lease's rows and marks the item done; a stale token or a second commit is rejected.

        A crash between the two leaves a published output without mark: the next lease's commit keeps it and sets the
        mark.
        """
        last = self._last(lease.item)
        if last is None or last.token != lease.token:
            raise StaleWriter(f"{lease.item}: token {lease.token}, newest {last.token if last else None}")
        if self._fs.exists(self._path(f"{self.base}/done/{lease.item}")):
            raise StaleWriter(f"{lease.item} is done")
        out = self._path(self.output(lease.item))
        if not self._fs.exists(out):
            try:
                self._fs.rename(self._path(self.staging(lease)), out)
            except Exception as e:
                if not self._fs.exists(out):
                    raise RuntimeError(f"{lease.item} was not published") from e
        if not self._create(f"{self.base}/done/{lease.item}", {"token": lease.token, "worker": lease.worker}):
            raise StaleWriter(f"{lease.item} is done")
        self._fs.delete(self._path(f"{self.base}/work/{lease.item}"), True)

    def process(self, worker: str, work: Callable[[str], DataFrame]) -> list[str]:
        """Works off every pending item: ``work(item)`` gives its rows. An item lost to another worker is left to it."""
        done = []
        for item in self._names(f"{self.base}/items"):
            if (got := self.lease(worker, item)) is None:
                continue
            work(item).write.mode("overwrite").parquet(self.staging(got))
            try:
                self.commit(got)
            except StaleWriter:
                continue
            done.append(item)
        return done

    def results(self) -> DataFrame | None:
        """The rows of all committed items, each exactly once."""
        paths = [self.output(item) for item in self._names(f"{self.base}/done")]
        return self.spark.read.parquet(*paths) if paths else None
