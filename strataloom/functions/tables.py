"""The extractors as SQL table functions, one for each row family: ``extract_symbols(path, language, text)`` and so on.

For queries over a few files; ``extract.engine.extract`` runs whole tables in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataloom.artifact.schema import FAMILIES, TABLES


def _function(family: str):
    names = TABLES[family].names

    class Extract:
        def eval(self, path: str, language: str, text: str):
            from strataloom.extract.engine import extract_file

            if text is None or language is None:
                return
            for row in extract_file(path or "", language, text)[family]:
                yield tuple(row.get(n) for n in names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[family])
    return F.udtf(Extract, returnType=schema)


def register(spark: SparkSession, prefix: str = "extract_") -> list[str]:
    """Registers the functions; returns their names."""
    for f in FAMILIES:
        spark.udtf.register(prefix + f, _function(f))
    return [prefix + f for f in FAMILIES]
