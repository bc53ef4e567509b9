"""Source files that do not parse: flagged per file, with rates per repository and language.

Every file is tokenised and run through the grammars of its language's dialects together, on one graph-structured
stack; it is invalid when every dialect rejects it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import grammars as g
from strataloom.llm import lexers
from strataloom.llm.gll import Grammar
from strataloom.session import spread

#: Language to grammar, dialects (start symbols) and lexer.
LANGUAGES: dict[str, tuple[str, tuple[str, ...], Callable]] = {
    "json": (g.JSON, ("Json",), lexers.json_tokens),
    "toml": (g.TOML, ("Toml",), lexers.toml_tokens),
    "python": (g.PYTHON, ("Python",), lexers.python_tokens),
    "java": (g.JAVA, ("CompilationUnit", "ModuleUnit"), lexers.java_tokens),
    "go": (g.GO, ("Go",), lexers.go_tokens),
    "rust": (g.RUST, ("Rust",), lexers.rust_tokens),
    "javascript": (g.JAVASCRIPT, ("Script",), lexers.javascript_tokens),
    "typescript": (g.TYPESCRIPT, ("Script",), lexers.typescript_tokens),
}


@lru_cache(None)
def grammar(language: str) -> Grammar:
    """The compiled grammar, once per worker."""
    text, starts, _ = LANGUAGES[language]
    return Grammar(text, starts)


def accepted_by(language: str, content: str) -> list[str]:
    """The dialects that accept a file's content."""
    kinds, may_end = LANGUAGES[language][2](content)
    if "ERR" in kinds:
        return []
    return grammar(language).accepts(kinds, may_end)


def confirmed(language: str, content: str) -> bool:
    """The exact check after a rejection, where the standard library has the language's own parser."""
    try:
        if language == "python":
            import ast

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(content)
        elif language == "toml":
            import tomllib

            tomllib.loads(content)
        else:
            return True
    except (ValueError, SyntaxError):
        return True
    except (RecursionError, MemoryError):
        return True
    return False


def is_valid(language: str | None, content: str | None) -> bool | None:
    """Whether content is syntactically valid; None for null content and for languages without a grammar.

    Markdown is always valid, and so is empty content in any language.
    """
    if content is None or language is None:
        return None
    if content == "" or language == "markdown":
        return True
    if language not in LANGUAGES:
        return None
    return bool(accepted_by(language, content)) or not confirmed(language, content)


VERDICT = "file_id string, path string, language string, valid boolean"


def verdicts(snapshots: DataFrame) -> DataFrame:
    """One row per file: ``file_id, path, language, valid`` (null: nothing to judge, see ``is_valid``).

    Repeated rows count once; of several texts of one file each is judged and the file is invalid when the greatest
    text is. Rows with null file_id are left out. Files are parsed where they are read and only verdicts are
    shuffled; a file is parsed whole.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("file_id", pa.string()), ("path", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("rank", pa.string())])
        for b in batches:
            ok = [is_valid(l, c) for l, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ok, pa.bool_()), b.column(4)], schema=schema)

    cols = [*(F.col(c).cast("string").alias(c) for c in ("file_id", "path", "language", "content")), F.sha2("content", 256).alias("rank")]
    judged = spread(snapshots.where("file_id is not null").select(*cols)).mapInArrow(run, VERDICT + ", rank string")
    best = F.max(F.struct("rank", "path", "language", "valid")).alias("v")
    return judged.groupBy("file_id").agg(best).select("file_id", "v.path", "v.language", "v.valid")


def rates(judged: DataFrame, files: DataFrame, changes: DataFrame, samples: DataFrame) -> DataFrame:
    """Rates per repository and language, ``None`` standing for a null language.

    The repository is the first segment of the path; a file of the journal or of ``files`` without a snapshot counts as
    ``unread``. ``stale_hints``: files whose pinned diagnostic count contradicts the verdict.
    """
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), r"^(\./)+|/(?=/)", "")
    known = (
        files.select("file_id", clean("path").alias("path"), "language", F.lit(0).alias("o"))
        .unionByName(changes.select("file_id", clean("path").alias("path"), F.lit(None).cast("string").alias("language"), F.lit(1).alias("o")))
        .where("file_id is not null")
        .groupBy("file_id")
        .agg(F.min(F.struct("o", "path", "language")).alias("k"))
        .select("file_id", F.col("k.path").alias("k_path"), F.col("k.language").alias("k_language"))
    )
    hint = samples.groupBy(F.col("source_path").alias("path")).agg(F.max("expected_parse_diagnostics").alias("expected"))
    all_ = judged.join(known, "file_id", "full").select(
        F.coalesce("path", "k_path").alias("path"), F.coalesce("language", "k_language").alias("language"), "valid",
        F.col("path").isNotNull().alias("read"),
    ).join(hint, "path", "left")
    return all_.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("repository"), "language").agg(
        F.count("*").alias("files"), F.count_if(F.col("read")).alias("read"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(~F.col("read")).alias("unread"),
        F.count_if(F.col("expected").isNotNull() & F.col("valid").isNotNull() & ((F.col("expected") > 0) == F.col("valid"))).alias("stale_hints"),
    ).withColumn("rate", F.when(F.col("read") > 0, F.col("invalid") / F.col("read")))
