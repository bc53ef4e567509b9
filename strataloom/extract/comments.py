"""What a file's mask alone gives: the hash of its tokens without comments, and the markers in its comments."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.extract import patterns as P
from strataloom.extract.mask import Masked, mask
from strataloom.session import spread
from strataloom.sources.languages import LANGUAGES

_TOKEN = re.compile(r"\w+|[^\w\s]")
_LEAD = re.compile(r"^(?:///?|//!|/\*\*?|\*(?!/)|#+|--+|;+|<!--|%+)\s*")
_TRAIL = re.compile(r"\s*(?:\*/|-->)\s*$")


def markers(m: Masked) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Every comment line that begins with a marker: start, end and its parts."""
    for r in m.regions:
        if r.kind == "string_literal":
            continue
        at = r.start
        for line in m.text[r.start : r.end].split("\n"):
            if hit := re.match(P.MARKER, _TRAIL.sub("", _LEAD.sub("", line.strip()))):
                yield at, at + len(line), {k: v for k, v in hit.groupdict().items() if v}
            at += len(line) + 1


def token_hash(m: Masked) -> str:
    """md5 of the tokens without comments, a string being one token: equal for exact clones in any layout."""
    tokens, at = [], 0
    for r in m.regions:
        if r.kind == "string_literal":
            tokens += _TOKEN.findall(m.bare[at : r.start])
            tokens.append(m.text[r.start : r.end])
            at = r.end
    tokens += _TOKEN.findall(m.bare[at:])
    return hashlib.md5("\x1f".join(tokens).encode("utf-8", "surrogatepass")).hexdigest()


def marks(files: DataFrame) -> DataFrame:
    """``file_id, language, content_md5, token_hash, markers`` of files (file_id, language, text), one row each.

    A null text or unknown language gives no hash and no markers.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for file_id, language, text in zip(*(b.column(c).to_pylist() for c in ("file_id", "language", "text"))):
                m = mask(text, language) if text is not None and language in LANGUAGES else None
                rows.append({
                    "file_id": file_id, "language": language, "content_md5": hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() if text is not None else None,
                    "token_hash": token_hash(m) if m else None, "markers": [x[2]["marker"] for x in markers(m)] if m else [],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*((c, pa.string()) for c in ("file_id", "language", "content_md5", "token_hash")), ("markers", pa.list_(pa.string()))]))

    return spread(files.select("file_id", "language", F.col("text"))).mapInArrow(run, "file_id string, language string, content_md5 string, token_hash string, markers array<string>")
