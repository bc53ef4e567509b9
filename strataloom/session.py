"""Session helpers: table access, lineage cuts, UTC instants."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one test table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the cluster names none (tests) a local one is set."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    own = os.path.join(tempfile.gettempdir(), "strataloom-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table written in the shared folder, and its place: readers load only the columns they need."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a staged table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utc_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch of a text with a zone, a timestamp, or a timestamp without zone meaning UTC.

    Null, empty and unreadable values give null; the session's zone plays no part.
    """
    kind = df.schema[col].dataType.typeName()
    c = F.col(f"`{col}`")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.concat(c.cast("string"), F.lit("Z")).try_cast("timestamp"))
    return F.unix_micros(c.try_cast("timestamp"))


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a context: executors need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_shipped", False):
        return
    import io
    import zipfile
    from pathlib import Path
    from urllib.parse import urlparse

    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    base = shared_dir(spark).rstrip("/")
    name, place = f"strataloom-{sc.applicationId}.zip", urlparse(base)
    if place.scheme in ("", "file"):
        folder = Path(place.path)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(packed.getvalue())
        sc.addPyFile(str(folder / name))
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(f"{base}/{name}")
    sc._strataloom_shipped = True


def spread(df: DataFrame, per_core: int = 4 << 20) -> DataFrame:
    """Spreads an input too small to keep all cores busy by its file splits, for work that is heavy on CPU.

    Judged by the plan's own size estimate: beyond ``per_core`` bytes a core the scan's splits do, and nothing is
    shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * 2) if 0 < size < cores * per_core else df
