"""Incremental scans by stream: new and changed files of a folder update an artifact batch by batch.

The file source hands over each file once; ``foreachBatch`` applies it with the artifact's own commit, which a
repeated batch finds unchanged, so failures neither skip nor repeat a file. There is no event time, hence no
watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataloom.artifact.engine import Engine
from strataloom.functions.text import relative_to
from strataloom.session import cut
from strataloom.sources.snapshot import plain_path, snapshots


def follow(engine: Engine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the stream; with ``available_now`` it ends when all present files are in."""
    root = engine.root or folder

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rows = batch.groupBy(relative_to(plain_path("path"), root).alias("path")).agg(F.max_by("content", "modificationTime").alias("content"))
        version = engine.store.version()
        if not version:
            engine.scan(rows)
            return
        level = engine.store.check(engine.root)["metadata"]["index_level"]
        engine._apply(cut(snapshots(rows)), level, version, "update", whole=False)

    stream = (
        engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").load(folder)
    )
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
