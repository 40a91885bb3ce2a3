"""A training-data pipeline over documents: each stage is one operator of lexloom.llm, written as Parquet and reread.

``run(spark, sf_dir)`` applies the stages to ``{sf_dir}/documents.parquet``. All stages but the last return the columns
of documents. No stage drops work: each reads all rows that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import langid, minhash, mixing, pieces, templates
from lexloom.llm.common import Scratch, fresh, sources
from lexloom.llm.queries import piece_model

#: A language below this share of the likelihood is no decision.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or without a clear language go."""
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.lit(False))
    predicted, score = fresh(docs.columns, "__lang_pred"), fresh(docs.columns, "__score")
    found = langid.predict(docs, model, (predicted, score))
    return sources(found.where((F.col(predicted) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)), *docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and lines copied from another text go, but for their first document. A document that loses all its lines goes."""
    every, gone = fresh(docs.columns, "__n_lines"), fresh(docs.columns, "__n_removed")
    out = templates.drop_templates(docs, added=(every, gone))
    out = out.where((F.col(gone) < F.col(every)) | (F.col(gone) == 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return sources(out, *docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least doc_id stays.

    Rows go by doc_id and text: rows of one doc_id with other texts are judged for themselves, repeated rows alike. Of a
    group without any doc_id all rows stay; one without a doc_id goes if its group has one.
    """
    gone = minhash.near_duplicates(docs, n=5, percent=80).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    return sources(_by_row(docs, gone, "left_anti"), *docs.columns)


def _by_row(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Joins the documents with a table of doc_id, text_hash and other columns, also where doc_id is null."""
    text, own = fresh(docs.columns, "__text_hash"), fresh(docs.columns, "__doc_id")
    other = table.withColumnsRenamed({"doc_id": own, "text_hash": text})
    return docs.join(other.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own)) & (minhash.text_hash() == F.col(text)), how)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes once for each pass of the mix that takes half of it or more.

    Documents without words go. Rows of one doc_id and text are taken as often as the one of them that is taken most.
    """
    count, copy = fresh(docs.columns, "__times"), fresh(docs.columns, "__copy")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    times = mixing.taken(docs).groupBy("doc_id", "text_hash").agg(F.max(times).alias(count)).where(F.col(count) > 0)
    joined = _by_row(docs, times, "inner")
    return sources(joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))), *docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with what shows that they give the text back."""
    out = pieces.encode(sources(docs, "doc_id", "lang", "source", "text"), piece_model())
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: SQL cannot express language identification, MinHash or the encoding; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept.save(stage(spark, docs, sf_dir), name)
    return docs
