"""Reading source trees and text tables into file snapshots."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.ids import content_hash, stable_id
from strataloom.functions.text import line_count, normalize_path, relative_to
from strataloom.sources.languages import detect, is_json_lines

#: Files larger than this are registered, not extracted.
SIZE_LIMIT = 1 << 20
# Directories a walk never enters.
EXCLUDED = (".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv", ".idea", ".vscode")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 after its mark (an odd length is an error), else strict UTF-8; null where it can't be read."""
    head = F.hex(F.substring(content, 1, 2))
    odd = F.octet_length(content) % 2 == 1
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return (
        F.when(head.isin("FFFE", "FEFF") & odd, None)
        .when(head == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE"))
        .when(head == "FEFF", F.decode(F.expr("substring(content, 3)"), "UTF-16BE"))
        .otherwise(F.regexp_replace(utf8, "^﻿", ""))
    )


def decode_status(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 2))
    odd = F.octet_length(content) % 2 == 1
    return (
        F.when(head.isin("FFFE", "FEFF"), F.when(odd, "odd_utf16").when(head == "FFFE", "utf16le").otherwise("utf16be"))
        .when(F.is_valid_utf8(content.cast("string")), "utf8")
        .otherwise("invalid_utf8")
    )


def plain_path(col: str) -> Column:
    """The file system path of a file source's path column, which is not encoded."""
    return F.regexp_replace(col, r"^[a-z]+:/+", "/")


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders of a tree that a walk enters, from the file system; excluded ones are never listed."""
    if "://" not in root and os.path.isdir(root):
        out = []
        for at, below, _ in os.walk(root):
            below[:] = [d for d in below if d not in EXCLUDED]
            out.append(at)
        return out
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo, out = [path(root)], []
    while todo:
        at = todo.pop()
        out.append(at.toString())
        todo += [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName() not in EXCLUDED]
    return out


def _escape(path: str) -> str:
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


_RAW = "path string, modificationTime timestamp, length long, content binary"


def _local_files(root: str) -> Iterator[tuple[str, int, str]]:
    todo = [root.rstrip("/") or "/"]
    start = len(todo[0]) + 1
    while todo:
        with os.scandir(todo.pop()) as entries:
            for e in entries:
                if e.is_dir():
                    if e.name not in EXCLUDED:
                        todo.append(e.path)
                elif not e.name.startswith(("_", ".")):  # as Spark's file sources
                    st = e.stat()
                    yield e.path[start:], st.st_size, str(st.st_mtime_ns // 1_000_000)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """A source tree's files without their contents: ``path, content_bytes, modified`` (milliseconds, as text)."""
    if "://" not in root and os.path.isdir(root):
        import pyarrow as pa

        rows = list(zip(*_local_files(root))) or [[], [], []]
        schema = pa.schema([("path", pa.string()), ("content_bytes", pa.int64()), ("modified", pa.string())])
        return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(rows, schema)], schema=schema))
    raw = spark.read.format("binaryFile").schema(_RAW).load([_escape(f) for f in folders(spark, root)])
    rel = relative_to(plain_path("path"), root)
    return raw.select(rel.alias("path"), F.col("length").alias("content_bytes"), F.unix_millis("modificationTime").cast("string").alias("modified"))


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """Given files of a tree with their contents."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary, modified string")
    raw = spark.read.format("binaryFile").schema(_RAW).load([_escape(f"{root.rstrip('/')}/{p}") for p in paths])
    return raw.select(relative_to(plain_path("path"), root).alias("path"), "content", F.unix_millis("modificationTime").cast("string").alias("modified"))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """A source tree as ``path, content (bytes), modified``; excluded folders are not listed."""
    raw = spark.read.format("binaryFile").schema(_RAW).load([_escape(f) for f in folders(spark, root)])
    return raw.select(relative_to(plain_path("path"), root).alias("path"), "content", F.unix_millis("modificationTime").cast("string").alias("modified"))


def split_known(listed: DataFrame, files: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The listed files that have to be read, and those whose size and time are the recorded ones (``file_id``)."""
    if files is None:
        return listed, None
    was = files.select("file_id", F.col("path").alias("p"), F.col("content_bytes").alias("b"), F.get_json_object("metadata_json", "$.modified").alias("m"))
    both = listed.join(was, normalize_path(F.col("path")) == F.col("p"), "left")
    known = F.coalesce((F.col("b") == F.col("content_bytes")) & (F.col("m") == F.col("modified")), F.lit(False))
    return both.where(~known).select(*listed.columns), both.where(known).select("file_id")


#: Changed files that are read by their paths; beyond them the tree is read and the others dropped unread by the join.
BY_PATH = 500


def read_listed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """The contents of listed files."""
    paths = [r.path for r in listed.select("path").limit(BY_PATH + 1).collect()]
    if len(paths) <= BY_PATH:
        return read_paths(spark, root, paths)
    return scan_tree(spark, root).join(listed.select("path"), "path", "left_semi")


def snapshots(files: DataFrame) -> DataFrame:
    """Raw files (path, content bytes, and where known the time modified) to snapshots: file_id, language, text, hash, bytes, lines, status."""
    text = decoded(F.col("content"))
    modified = F.col("modified").cast("string") if "modified" in files.columns else F.lit(None).cast("string")
    out = files.select(
        normalize_path(F.col("path")).alias("path"), text.alias("text"), content_hash(F.col("content")).alias("content_hash"),
        F.octet_length("content").cast("long").alias("content_bytes"), decode_status(F.col("content")).alias("decode_status"), modified.alias("modified"),
    )
    lang = detect(F.col("path"), F.col("text"))
    out = out.withColumn("language", lang)
    status = F.when(F.col("language").isNull(), "unsupported").when(F.col("text").isNull(), "failed_preserved").otherwise("indexed")
    return out.select(
        stable_id("file", F.col("path")).alias("file_id"), "path", F.coalesce("language", F.lit("unsupported")).alias("language"), "text", "content_hash",
        "content_bytes", F.when(status == "indexed", line_count(F.col("text"))).alias("line_count"), status.alias("status"), "decode_status",
        (F.col("content_bytes") > SIZE_LIMIT).alias("too_large"), is_json_lines(F.col("path")).alias("json_lines"), "modified",
    )
