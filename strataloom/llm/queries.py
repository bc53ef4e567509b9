"""The pN_ queries of the llm operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, docpairs, lookalikes, mixture, syntax
from strataloom.session import cut, table


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "symbols"), table(spark, d, "file_snapshots"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("symbol_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(table(spark, d, "file_snapshots")).where("not valid").select("file_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    judged = syntax.verdicts(table(spark, d, "file_snapshots"))
    return syntax.rates(judged, table(spark, d, "files"), table(spark, d, "revision_file_changes"), table(spark, d, "coverage_samples"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids do not decode to their text (there are none), with the number of all documents beside."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = bpe.decode_column(bpe.encode_column(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").agg(
        F.count("*").alias("documents"), F.count_if(F.coalesce("text", F.lit("")) != F.col("back")).alias("broken")
    )


def _sizes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mixture_targets")
    return cut(bpe.count_column(table(spark, d, "documents"), ["doc_id", "source"], "text")), targets


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d)
    return mixture.draw(sizes, targets)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d)
    return mixture.shares(mixture.draw(sizes, targets), sizes, targets)


def p7_corpus_shares(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture as large as what the target sources hold: most targets cannot be met then."""
    sizes, targets = _sizes(spark, d)
    whole = sizes.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0
    return mixture.shares(mixture.draw(sizes, targets, total=whole), sizes, targets, total=whole)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_pairs(table(spark, d, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.forms(table(spark, d, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each visible text's class, named by the smallest document of the same look."""
    c = lookalikes.classes(table(spark, d, "documents"), "doc_id", "text")
    named = c.groupBy("class_id").agg(F.min("doc_id").alias("class_doc"), F.countDistinct("text_hash").alias("spellings"))
    return c.join(named, "class_id").select("doc_id", "class_doc", "spellings")


QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p7_corpus_shares": p7_corpus_shares,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
    "p8_classes": p8_classes,
}

_FORM = f"WITH f AS ({lookalikes.form_select('documents', ('doc_id', 'text'), 'text')}) "
ORACLE = {
    "p6_round_trip": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS broken FROM documents",
    "p8_forms": _FORM + "SELECT doc_id, f AS form FROM f",
    "p8_found": _FORM + """
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text
WHERE regexp_matches(a.f, '\\S')""",
    "p8_classes": _FORM + """
SELECT doc_id, min(doc_id) OVER w AS class_doc, (SELECT count(DISTINCT g.text) FROM f g WHERE g.f = f.f) AS spellings
FROM f WHERE regexp_matches(f, '\\S') WINDOW w AS (PARTITION BY f)""",
}
